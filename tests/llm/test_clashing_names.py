"""Stages that return whole rows keep columns named like their own helpers."""

from cobbler.llm import contamination, jaccard, lines


def test_stages_keep_columns_named_like_their_helpers(spark):
    names = ["__id", "__key", "__gone", "__lines", "__ID_", "node", "sig"]
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text + "\nfirst"), (2, text + "\nfirst"), (3, "quite another text of some words that nobody else has in his own"), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, *[f"c{k}{i}" for i in range(len(names))]) for k, r in enumerate(rows)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    assert {r["doc_id"]: (r["text"], r["__n_dropped"], r["__id"], r["__lines"]) for r in got.collect() if r["doc_id"] in (1, 2, 4)} == {
        1: (rows[0][1], 0, "c00", "c03"), 2: ("", 2, "c10", "c13"), 4: (None, 0, "c30", "c33")}
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r["__gone"] for r in one.collect()) == ["c02", "c22", "c32", "c42"]
    items = spark.createDataFrame([(7, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    clean = contamination.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r["__key"] for r in clean.collect()) == ["c21", "c31", "c41"]
