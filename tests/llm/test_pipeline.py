import hashlib

from samples import make
from test_corpus_operators import brute_classes, brute_contamination, brute_lines

from test_text_operators import brute_bits

from nearkin.llm import language_id as lid
from nearkin.llm import pipeline as pipe
from nearkin.llm.line_dedup import kept_text


ITEM = "w11 w222 w33 w144 w55 w166 w77 w188"


def columns(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows = [r for r in corpus if r[0] is not None and r[0] not in (300, 301)]
    rows += [(800, f"w1 w2 w3 {ITEM} w9")]
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(spark, rows)
    names = [n for n, _ in pipe.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    stage = dict(pipe.STAGES)

    spoken = stage["language_id"](spark, docs, str(tmp_path))
    assert spoken.columns == list(pipe.COLUMNS)
    learned = [r[0] for r in lid.learned_from(docs).collect() if r[0] is not None]
    good = sorted(d for d, t, *_ in rows if t and any(map(str.isalpha, t)) and (len(t) > 1000 or brute_bits(learned, t) < pipe.REJECT_BITS * len(t.encode())))
    assert sorted(r["doc_id"] for r in spoken.collect()) == good and {r["lang"] for r in spoken.collect()} == {"en"}
    assert {0, 1, 4, 5} & set(good) == set() and 800 in good

    before = columns(spoken)
    gone = brute_lines(before)
    want = sorted((i, kept_text(t, gone[i])) for i, t in before if not gone[i] or len(gone[i]) < sum(map(bool, t.split("\n"))))
    cut = stage["line_dedup"](spark, spoken, str(tmp_path))
    assert cut.columns == list(pipe.COLUMNS) and sorted(columns(cut)) == want

    classes, _ = brute_classes(want, pipe.NEAR_PERCENT)
    single = stage["near_dedup"](spark, cut, str(tmp_path))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c in classes.items() if i == c)

    clean = stage["decontaminate"](spark, single, str(tmp_path))
    bad = {r[0] for r in brute_contamination(columns(single), [(1, ITEM)], 10) if r[5]}
    assert 800 in bad and sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in columns(single) if i not in bad)

    last = {r["doc_id"]: r for r in stage["sentencepiece"](spark, clean, str(tmp_path)).collect()}
    assert all(last[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in columns(clean))


def test_stages_take_odd_rows_and_empty_tables(spark, corpus, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (corpus, []):
        docs = make(spark, rows)
        for name, stage in pipe.STAGES:
            made = stage(spark, docs, str(tmp_path))
            place = f"{tmp_path}/{name}-{len(rows)}"
            made.write.parquet(place)
            docs = spark.read.parquet(place)
            if rows:
                assert docs.where("doc_id is null").count() == 1  # a text without an id is no duplicate of anything
            if rows and name in ("near_dedup", "decontaminate"):
                assert docs.where("doc_id in (300, 301)").count() == 3  # one of each text
        assert (docs.count() > 0) == bool(rows)


def test_rows_are_judged_by_their_own_texts(spark, tmp_path):
    """Neither a missing nor a repeated id takes other rows along."""
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"bad {ITEM}"), (None, "good one"), (7, f"also bad {ITEM}"), (7, "good two"), (8, "good two"), (9, "good three words"), (9, "good one too")]
    for name, want in (("decontaminate", [(None, "good one"), (7, "good two"), (8, "good two"), (9, "good one too"), (9, "good three words")]), ("near_dedup", [(None, "good one"), (7, "good two"), (9, "good one too"), (9, "good three words")])):
        make(spark, rows).select(*pipe.COLUMNS).write.parquet(f"{tmp_path}/{name}-in")
        dict(pipe.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/{name}-in"), str(tmp_path)).write.parquet(f"{tmp_path}/{name}-out")
        left = spark.read.parquet(f"{tmp_path}/{name}-out")
        assert sorted(columns(left), key=lambda r: (r[0] is not None, r)) == want
        rows = [(r["doc_id"], r["text"]) for r in left.collect()]


def test_run_over_a_whole_table(spark):
    got = pipe.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 100 < got.count() <= 200
