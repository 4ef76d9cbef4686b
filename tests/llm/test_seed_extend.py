import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import seed_extend as S
from tests.llm.conftest import frame


def brute(rows, length=13):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            first[key] = min(first.get(key, (2, 0)), (doc is not None, doc or 0))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < (doc is not None, doc or 0):
                gone.update(range(i, i + length))
        starts = [i for i in sorted(gone) if i - 1 not in gone]
        ends = [i + 1 for i in sorted(gone) if i + 1 not in gone]
        out.append((doc, len(words), starts, ends, b" ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r["doc_id"], r["n_words"], r["starts"], r["ends"], bytes(r["kept"])) for r in df.collect()), key=repr)


def odd_rows(sample):
    """The sample, with passages at the edges of others, many surroundings of one run, and one word over and over."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [*sample, (9000, passage), (9001, f"before it {passage}"), (9002, " ".join(passage.split()[5:40]) + " after"), (9003, " ".join(passage.split()[:12])), (9004, passage.upper()), (9005, f"x {passage} y {passage} z")]
    rows += [(9100 + i, f"a{i} b{i % 3} c " + "- " * 20 + f"d e{i % 2} f{i}") for i in range(40)]
    rows += [(9200 + i, "same " * (11 + i)) for i in range(5)]
    return rows


@pytest.mark.parametrize("partitions", [1, 20])
def test_matches_brute_force(spark, sample, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = odd_rows(sample)
        assert told(S.repeated_words(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("length", "seed"), [(13, 13), (4, 2), (1, 1)])
def test_other_lengths(spark, sample, length, seed):
    rows = odd_rows(sample)[-120:]
    assert told(S.repeated_words(frame(spark, rows), length=length, seed=seed)) == brute(rows, length)


def test_words_are_hashed_alike_in_any_chunks(monkeypatch):
    data = ("ab\tcd  ef\x0b\x1cgh é\u2028x " * 7 + "one" + "y" * 40 + " z").encode()
    hashes, places = S._word_hashes(data)
    assert [data[p:].split()[0] for p in places.tolist()] == data.split() and len(set(hashes.tolist())) == len(set(data.split()))
    for chunk in (1, 2, 5, 11, 64):
        monkeypatch.setattr(S, "CHUNK", chunk)
        again = S._word_hashes(data)
        assert (again[0] == hashes).all() and (again[1] == places).all()
    assert not len(S._word_hashes(b"")[0]) and not len(S._word_hashes(b" \n ")[0])


@pytest.mark.parametrize(("chunk", "size", "cut"), [(300, 3, 0.4), (50, 1, 0.5), (1 << 20, 7, 0.0), (900, 1000, 0.97)])
def test_edges_of_chunks_batches_and_partitions(sample, monkeypatch, chunk, size, cut):
    """The steps of a job in this process, with small chunks and batches and a partition border anywhere."""
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = [(i, t) for n, (i, t) in enumerate(odd_rows(sample)[-150:]) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    batch = lambda part: pa.record_batch([pa.array([d for d, _ in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array([t for _, t in part], pa.string())], ["doc", "mark", "text"])
    made = pa.Table.from_batches([x for half in (rows[::2], rows[1::2]) for x in S._seeded(13, 7)(iter([batch(half)]))]).to_pylist()
    runs = [(r["doc"], r["at"]) for r in made if r["kind"] == S.REPEATED]
    dealt = sorted(made, key=lambda r: (r["h"], r["f"], r["doc"]))
    border = int(len(dealt) * cut)
    open_ = []
    for part in (dealt[:border], dealt[border:]):
        batches = [pa.RecordBatch.from_pylist(part[i : i + size], S._SEEDS) for i in range(0, len(part), size)]
        for r in pa.Table.from_batches(list(S._settle(iter(batches)))).to_pylist() if batches else []:
            (runs if r["kind"] == S.REPEATED else open_).append((r["doc"], r["at"]))
    texts, windows = dict(rows), []
    wanted = {d: [at for x, at in open_ if x == d] for d in {d for d, _ in open_}}
    if wanted:
        given = pa.record_batch([pa.array(list(wanted)), pa.array([0] * len(wanted), pa.int64()), pa.array([texts[d] for d in wanted]), pa.array(list(wanted.values()), pa.list_(pa.int64()))], ["doc", "mark", "text", "wanted"])
        windows = pa.Table.from_batches(list(S._extended(13)(iter([given])))).to_pylist()
    first = {}
    for w in windows:
        first[w["w1"], w["w2"]] = min(w["doc"], first.get((w["w1"], w["w2"]), w["doc"]))
    runs += [(w["doc"], w["start"] << 32 | 1) for w in windows if w["doc"] > first[w["w1"], w["w2"]]]
    got = []
    for d, t in rows:
        spans = S._spans([at for x, at in set(runs) if x == d], 13)
        got.append((d, len(S._words(t)), [a for a, _ in spans], [b for _, b in spans], S._left(S._words(t), spans)))
    assert sorted(got, key=repr) == brute(rows) and any(g[2] for g in got)


def test_small_batches(spark, sample):
    rows = odd_rows(sample)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert told(S.repeated_words(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_of_one_id_and_no_id(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(None, words), (None, f"{words} more"), (1, f"x {words}"), (1, f"x {words}"), (1, f"{words} y"), (2, None), (3, ""), (4, words)]
    assert told(S.repeated_words(frame(spark, rows))) == brute(rows)
    assert S.repeated_words(frame(spark, rows).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        S.repeated_words(frame(spark, rows), seed=14)


def test_texts_without_repeats_and_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(20))
    clash = ["doc", "mark", "rest", "runs", "at", "h", "f", "kind", "w1", "w2", "start", "n", "first", "wanted", "repeats"]
    docs = frame(spark, [(1, f"{words}\n"), (2, f"a\n{words}  b"), (3, None), (4, "few  words")]).withColumns({c: F.lit(c) for c in clash})
    done = S.without_repeats(docs)
    assert done.columns == docs.columns
    assert {(r["doc_id"], r["text"], *(r[c] for c in clash)) for r in done.collect()} == {(1, f"{words}\n", *clash), (2, "a b", *clash), (3, None, *clash), (4, "few  words", *clash)}
