import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages_hand_on_documents(spark):
    from gridloom.llm import pii
    from gridloom.llm.common import materialize, table

    docs, sizes = table(spark, SF, "documents"), []
    columns = docs.columns
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if name == "quality":
            assert len(good & before - after) <= 0.05 * len(good)
        sizes.append(len(after))
    assert sizes[0] > sizes[2] > 0 and sizes[3] == sizes[2]
    assert pii.report(docs).selectExpr("sum(n_email + n_ip + n_card)").first()[0] == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns and empty tables."""
    from gridloom.llm.common import table

    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, sequence_id int, item_id long"
    real = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").limit(20).collect()]
    rows = [(i, t, "en", None, None, "clash", 1, 1) for i, t in enumerate(real)]
    rows += [rows[0], (100, None, None, None, None, None, None, None), (None, real[1], "en", "s", 1, None, None, None), (101, "", "en", "s", 0, "", 0, 0), (102, " ".join(real) * 40, "en", "s", 1, "", 0, 0), (1, real[1] + " another text of one id", "en", "s", 1, "", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        kept = out.collect()
        assert {r.doc_id for r in kept} <= {r[0] for r in rows}, name
        if name == "near_dedup":
            ids = [r.doc_id for r in kept]
            assert ids.count(0) == ids.count(1) == 1 and None in ids and 100 in ids and 101 in ids
        if name == "pii":
            assert len(kept) == len(rows) and next(r for r in kept if r.doc_id == 100).text is None
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows} and sum(r.doc_id == 0 and r.piece == 0 for r in packed) == 2


def near_copies(texts):
    """By brute force: for each text its class, the smallest index reachable over links of five-word shingles at 0.75."""
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_near_copies_of_the_pipeline_by_brute_force(spark):
    """What the second stage keeps of what the first kept, and that packing places every token of the rest once."""
    from gridloom.llm.common import materialize, table

    first = materialize(corpus_pipeline.quality_stage(spark, table(spark, SF, "documents"), SF))
    rows = sorted(first.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    label = near_copies([r.text for r in rows])
    second = corpus_pipeline.near_dedup_stage(spark, first, SF)
    assert {r.doc_id for r in second.select("doc_id").collect()} == {rows[i].doc_id for i, x in enumerate(label) if i == x}
    packed = corpus_pipeline.packing_stage(spark, second, SF).collect()
    taken = {}
    for r in packed:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in taken.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 4096
