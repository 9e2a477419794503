import corpus_pipeline
from conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for source in (docs, documents(ODD), documents([])):
        now = source
        counts = [now.count()]
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns
            now = corpus_pipeline.written(now, name)
            counts.append(now.count())
        assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]


def test_decisions_take_effect(spark, documents):
    from mailsift.llm.queries import op8_simhash_covering
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "clean words here " * 3), (2, "12 34"), (3, None), (4, passage + " " + " ".join(f"a{i}" for i in range(80))),
            (5, " ".join(f"b{i}" for i in range(100)) + " " + passage),
            (6, "copy of a text with words"), (7, "copy of a text with words"), (7, "copy of a text with words")]
    kept = corpus_pipeline.language_id(spark, documents(rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 7]
    one = corpus_pipeline.simhash_dedup(spark, kept, SF)
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 4, 5, 6]
    cut = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, one, SF).collect()}
    assert "p30" not in cut[4]["text"] and "p30" not in cut[5]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values() if r["doc_id"] in (4, 5))
    assert cut[1]["text"] == rows[0][1] and cut[1]["source"] == "s"
    groups = op8_simhash_covering(spark, SF).collect()
    reps = {r["component_id"] for r in groups}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.simhash_dedup(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(reps)


def test_cut_texts_keep_their_layout_and_emptied_ones_go(spark, documents):
    p = " ".join(f"p{i}" for i in range(40))
    q = "\n".join(f"q{i}" for i in range(36))
    code = "Title line\n\ndef f():\n    return 1\n"
    rows = [(1, f"{code}{p}\n\tnext  line\n"), (2, f"{p}\n tail"), (3, f"  head\n\n{p}\n"), (4, f" {p} "), (5, f"a {p}  b\n{q} c"),
            (6, f"x {q}"), (7, "clean  text\n"), (8, ""), (9, None), (None, p)]
    got = {r["doc_id"]: r for r in corpus_pipeline.substring_dedup(spark, documents(rows), SF).collect()}
    assert {i: r["text"] for i, r in got.items()} == {
        1: f"{code}next  line\n", 2: "tail", 3: "  head\n", 5: "a b\nc", 6: "x", 7: "clean  text\n", 8: "", 9: None}
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if i < 7)


def test_one_document_of_each_group_stays_with_null_and_repeated_ids(spark, documents):
    def text(group, copy):  # near copies: one word of 600 differs
        return " ".join(f"{group}{i}" for i in range(600)) + f" copy{copy}"

    rows = [(None, text("a", 1)), (None, text("a", 2)), (None, text("a", 3)),   # a group without any id
            (20, text("b", 1)), (None, text("b", 2)), (19, text("b", 3)),       # ids come before null
            (30, text("c", 1)), (30, text("c", 2)),                             # one id, two texts of one group
            (40, text("d", 1)), (3, text("d", 2)), (40, text("e", 1)), (41, text("e", 2)),  # one id in two groups
            (50, text("f", 1)), (50, text("f", 1)),                             # equal rows
            (None, text("g", 1)), (None, text("g", 1))]
    from mailsift.llm.simhash_covering import fingerprints
    near = {}
    for r, (_, t) in zip(fingerprints(documents(rows)).collect(), rows, strict=True):
        near.setdefault(t[0], []).append(r["fp"])
    assert all(((x ^ y) & (2 ** 64 - 1)).bit_count() <= 4 for v in near.values() for x in v for y in v)
    left = corpus_pipeline.simhash_dedup(spark, documents(rows), SF).collect()
    assert sorted(r["text"][0] for r in left) == list("abcdefg")
    assert {r["text"][0]: r["doc_id"] for r in left} == {"a": None, "b": 19, "c": 30, "d": 3, "e": 40, "f": 50, "g": None}
    again = corpus_pipeline.simhash_dedup(spark, documents(rows[::-1]).repartition(5), SF).collect()
    assert sorted(r["text"] for r in again) == sorted(r["text"] for r in left)
