"""Small frames with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: Names that operators use inside, as columns of the user's own.
CLASHING = "size long, score double, row long, shard int, uid long, u double, before long, s string, p long, drops int, place long, labels string"
EXTRA = (7, 0.5, 1, 2, 3, 0.25, 9, "s", 4, 5, 6, "x")


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None, str | None]]:
    base = words(120, 1)
    rows: list[tuple[int | None, str | None, str | None]] = [(i, words(20 + 7 * i % 90, 100 + i), f"src{i % 3}") for i in range(40)]
    rows += [(50 + i, base, "src0") for i in range(6)]                                  # a group of copies
    rows += [(60 + i, base + f" extra{i}", "src1") for i in range(4)]                   # near copies
    rows += [(70, None, "src1"), (71, "", "src2"), (72, words(30, 5), None), (None, words(25, 6), "src0")]
    rows += [(73, words(40, 7), "src2")] * 2                                            # a repeated row
    rows += [(74, words(6000, 8), "src0"), (75, "one", "src1"), (76, "one", "src1"), (77, "  \n\t ", "src2")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or "")) + EXTRA for i, t, s in rows],
        f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}",
    )
