import numpy as np

from tallyward.llm import quality_rules


def prose(rng):
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(120)]
    return ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, 120, 12)) + "."


def junk(rng):
    return " ".join("".join(rng.choice(list("#$%&<>0123456789XYZ"), 14)) for _ in range(80))


def test_small_cells_are_measured(spark):
    """Junk of a rare source or a rare language is told by its language's rows, or by all."""
    rng = np.random.default_rng(31)
    rows = [(i, prose(rng), "en", "web") for i in range(300)]
    rows += [(1000 + i, junk(rng), "en", "x") for i in range(40)]
    rows += [(2000 + i, junk(rng), "is", "y") for i in range(20)] + [(3000 + i, junk(rng), None, None) for i in range(5)]
    rows += [(4000 + i, prose(rng), "en", "z") for i in range(20)]
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed or r.distance is None for r in got)
    assert not any(r.kept for r in got if 1000 <= r.doc_id < 4000)
    assert sum(r.kept for r in got if r.doc_id < 300 or r.doc_id >= 4000) >= 300
