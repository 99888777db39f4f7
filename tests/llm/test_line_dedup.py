from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speakable.llm.line_dedup import boilerplate, drop_boilerplate, without_boilerplate

SPACES = " \t\n\v\f\r"


def plain(rows, ratio, least):
    pages, seen = {}, {}
    for _, site, text in rows:
        pages[site] = pages.get(site, 0) + 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(SPACES):
                seen[site, line] = seen.get((site, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, site, text in rows:
        if text is None:
            out.append((i, 0, 0, None))
        else:
            lines = text.split("\n")
            kept = [x for x in lines if (site, x) not in bad]
            out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ROWS = [(i, "big", f"menu\nbody {i}\n\nmenu\nfoot é") for i in range(40)]
ROWS += [(100 + i, "small", f"menu\nother {i}") for i in range(2)]
ROWS += [(200 + i, None, f"no site\n  \n{i}") for i in range(4)]
ROWS += [(300, "big", None), (301, "big", ""), (302, "lone", "menu\nmenu\nmenu"), (303, "big", "foot é"), (303, "big", "foot é"), (None, "big", "menu"), (304, "big", "x\n" * 50_000)]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_equals_plain_python(spark, broadcast_rows):
    docs = spark.createDataFrame([(i, s, t, 5, "z") for i, s, t in ROWS], "doc_id long, source string, text string, n int, site string")
    got = drop_boilerplate(docs, ratio=0.5, min_pages=3, broadcast_rows=broadcast_rows).select("row.doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(ROWS, 0.5, 3), key=str)
    back = without_boilerplate(docs, ratio=0.5, min_pages=3, broadcast_rows=broadcast_rows)
    assert back.columns == docs.columns and back.count() == len(ROWS) and {r.site for r in back.collect()} == {"z"}
    assert drop_boilerplate(docs.filter(F.lit(False)), broadcast_rows=broadcast_rows).count() == 0


def test_ratio_is_exceeded_strictly(spark):
    rows = [(i, "a", "head" if i < 5 else "tail") for i in range(10)]
    pages = spark.createDataFrame([(s, t) for _, s, t in rows], "site string, text string")
    assert boilerplate(pages, 0.5, 1).count() == 0 and boilerplate(pages, 0.49, 1).count() == 2
