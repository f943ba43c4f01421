"""What is registered."""

import __spark_entry__
import corpus_pipeline


def test_registered_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality",
        "near_duplicates",
        "decontamination",
        "secrets",
        "packing",
    ]
