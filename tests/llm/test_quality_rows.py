"""Operator 5: the bound on teaching documents is not lowered for memory."""

import inspect

from marlstone.llm import quality


def test_teaching_documents_a_class():
    assert inspect.signature(quality.fit).parameters["fit_rows"].default >= 2500
