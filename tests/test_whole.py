"""Queries on written tables where a shortened form of the work gives other rows."""

from scriptorium.plans import corpus, evidence, search

HEAD, TAIL = "a red fox went over the old bridge and far into the grey hills at dawn. ", "then it slept under the tall oak until noon"


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def items_and_documents(spark, folder):
    docs = [(1, HEAD + TAIL), (2, HEAD + "but nothing else of it is here"), (3, "before it. " + TAIL.replace(" ", "\n")), (4, "short one"), (5, None)]
    items = [(7, HEAD + TAIL), (8, HEAD + "other\n" + TAIL), (9, "short one"), (10, None)]
    return write(
        spark, folder, documents=([(k, t, "en", None, None, None) for k, t in docs], "doc_id long, text string, lang string, source string, title string, record_key string"), eval_items=(items, "item_id long, text string")
    )


def test_literal_matches_are_of_whole_paragraphs(spark, tmp_path):
    got = {(r.doc_id, r.pattern_id) for r in corpus.u5_literal_matches(spark, items_and_documents(spark, tmp_path)).collect()}
    assert got == {(1, 7), (1, 8), (3, 8)}


def test_witness_holds_the_whole_quote(spark, tmp_path):
    got = {r.query_id: r.witness_rank for r in search.m7_witness_rank(spark, items_and_documents(spark, tmp_path)).collect()}
    assert set(got) == {7, 9}


def test_arrivals_rank_among_the_earlier_only(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i >= 100 else [0.6, 0.8]) for i in range(50, 450)]  # what comes after 100 is nearer to it
    folder = write(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    got = {(r.low, r.high) for r in evidence.x1_arrivals(spark, folder).collect()}
    assert got == {(i, 100) for i in range(50, 70)} | {(100 + i, s) for s in (200, 300, 400) for i in range(20)}
