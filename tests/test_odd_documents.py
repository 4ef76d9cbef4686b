"""Queries over documents that the test tables don't have, against their DuckDB SQL."""

import duckdb
import numpy as np
import pytest

from siltstone.functions import embedding as E
from siltstone.plans import catalogue, entry_points  # noqa: F401
from siltstone.plans.registry import ORACLE_SQL, QUERIES


def agreed(spark, path, name, texts):
    """The query's rows over documents with these texts, in order, after they were found to be the SQL's."""
    rows = [(i, text, "en", f"src{i % 3}", None if text is None else len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    found = sorted(map(tuple, QUERIES[name](spark, str(path)).select(*columns).collect()), key=repr)
    assert found == sorted(cursor.fetchall(), key=repr)
    return found


def test_words_that_cancel_each_other(spark, tmp_path):
    """'at' and 'to' have one place and opposite signs: by themselves their text has a vector only without signs."""
    texts = ["At to.", "to at at to", "At to it.", "", "...", "at", "la le de un"]
    found = agreed(spark, tmp_path, "embed_blake2b", texts)
    assert found == sorted(((i, None if i in (3, 4) else 1.0) for i in range(7)), key=repr)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain, whole = ([r["embedding"] for r in E.embed(docs, strict=False, unsigned=u).orderBy("doc_id").collect()] for u in (False, True))
    assert [v is None for v in plain] == [True, True, False, True, True, False, True]
    assert plain[2] == whole[2] and plain[5] == whole[5]  # where there is a vector, it is the same
    assert np.flatnonzero(whole[0]).tolist() == [E.place_of("at")[0]] and max(whole[0]) == 1.0
    assert sorted(set(np.flatnonzero(whole[6]))) == sorted({E.place_of(w)[0] for w in ("la", "le", "de", "un")}) and min(whole[6]) == 0
    with pytest.raises(Exception, match="cancel"):
        E.embed(docs.where("doc_id = 0")).collect()
    with pytest.raises(Exception, match="cancel"):
        E.embed(docs.where("doc_id = 4"), unsigned=True).collect()


def test_texts_that_have_no_page(spark, tmp_path):
    """Empty texts and nulls have no page, blank ones pages without text. Texts end everywhere about the borders of strings and pages."""
    ends = [1, 99, 100, 101, 299, 300, 301, 399, 400, 401, 599, 600, 601, 899, 900, 901, 1200, 1500, 1801]
    texts = ["", "", None, " ", "\n" * 700, *(("word (x) \\ \n" * 200)[:n] for n in ends), *((" " * 300 + "x" + "\n" * 1500)[:n] for n in ends)]
    found = agreed(spark, tmp_path, "pdf_constants", texts)
    assert {r[0] for r in found} == set(range(3, len(texts))) and {r[0] for r in found if r[2] is None} >= {3, 4}


def test_files_without_text(spark, tmp_path):
    """Empty and blank files are read; what is wrong with a path or a format is told of them too. The first is a file by itself, the others are packed."""
    texts = ["", "", "", "", " ", "", "\n\t", "", "", "", "x ", "", "# Title", " \n", "", "y", "", "", "", "", ""]
    found = {r[1]: r for r in agreed(spark, tmp_path, "seller_corpus", texts)}
    empty = "d41d8cd98f00b204e9800998ecf8427e"
    assert len(found) == len(texts) and {i for i, r in found.items() if r[2:] == (None, empty)} == {0, 1, 2, 4, 6, 8, 11, 13, 17, 19}
    assert {found[i][2] for i in (3, 14)} == {"path leaves its folder"} and {found[i][2] for i in (9, 20)} == {"no PDF"}
