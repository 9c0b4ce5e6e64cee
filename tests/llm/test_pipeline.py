"""Stages of the corpus pipeline against plain versions on small tables."""

import hashlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from trailmark.llm import pii
from trailmark.llm.queries import tokenizer_path


def words(text):
    return text.lower().split()


def near(a, b, width=5, num=80, den=100):
    x, y = ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (words(a), words(b)))
    return den * len(x & y) >= num * len(x | y)


def test_near_copies_at_080_to_085_go(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base + " " + " ".join(f"t{i}" for i in range(20)), base + " " + " ".join(f"u{i}" for i in range(30)), " ".join(f"v{i}" for i in range(100)), " ".join(["q", *[f"v{i}" for i in range(1, 100)]]), base.replace("w50 ", "z "), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    comp = {i: i for i in range(len(texts))}
    for _ in comp:
        for i in comp:
            for j in comp:
                if texts[i] and texts[j] and near(texts[i], texts[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert comp[1] == 0 and comp[2] == 2
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i in comp if comp[i] == i]


def test_a_hot_source_gives_way_to_the_entropy_target(spark):
    sources = ["hot"] * 950 + [f"s{i}" for i in range(19) for _ in range(100)]  # a third, and 19 equal others
    docs = spark.createDataFrame([(i, "one two three four", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    counts = {r.source: r["count"] for r in corpus_pipeline.mix_sources(spark, docs, "").groupBy("source").count().collect()}
    p = np.array(list(counts.values())) / sum(counts.values())
    assert -(p * np.log(p)).sum() >= 0.9695 * np.log(20) and 0.16 < counts["hot"] / sum(counts.values()) < 0.17
    assert counts["hot"] >= 950 and all(c >= 100 for c in counts.values())


def test_run_against_a_plain_version(spark, tmp_path):
    r = np.random.default_rng(1)
    vocabulary = {"en": "the of and with river over stone this".split(), "de": "der die und mit fluss über stein dies".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(r.choice(vocabulary[lang], 60)), lang, "hot" if i % 3 else f"s{i % 9}"))
    rows[10] = (10, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" ' + rows[10][1], *rows[10][2:])
    rows[12] = (12, rows[12][1] + " Password: hunterxyz", *rows[12][2:])
    base = rows[14][1]
    for i, extra in ((120, 11), (121, 30)):
        rows.append((i, base + " " + " ".join(r.choice(vocabulary["en"], extra)), "en", "s0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {x.doc_id: x.text for x in corpus_pipeline.identify_language(spark, docs, "").collect()}
    comp = {i: i for i in kept}
    for _ in range(3):
        for i in kept:
            for j in kept:
                if comp[i] != comp[j] and near(kept[i], kept[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert 14 in kept and comp[120] == 14 and not near(base, kept[120], 4, 85) and comp[121] == 121
    spark.conf.set("spark.trailmark.surrogate.key", "a key of this test")
    tok, replacer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), pii.Replacer(pii.session_key(spark))
    want = {}
    for i in kept:
        if comp[i] == i:
            want[i] = hashlib.sha256(np.array(tok.encode(pii.replaced(kept[i], replacer)[0], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.ids_sha256 for x in found} == want
    assert {10, 12} <= want.keys() and want[10] != hashlib.sha256(np.array(tok.encode(kept[10], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    copies = Counter("hot" if i in kept and rows[i][3] == "hot" else "small" for i in (x.doc_id for x in found))
    assert copies["small"] / sum(copies.values()) > 1.2 * sum(rows[i][3] != "hot" for i in want) / len(want)


def test_stages_on_empty_tables_nulls_and_clashing_names(spark):
    rows = [(None, "the river over stone and the river", "en", None), (None, None, None, "s"), (3, "", "en", "s"), (3, "the stone of this river with stone", "en", None), (4, "x " * 5000, "de", "t")]
    docs = spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, k string, component_id int, copies double")
    for frame in (docs, docs.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "")
            if name != "BPE":
                assert out.columns == docs.columns, name
                now = out
            out.collect()
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sum(r.doc_id is None for r in kept) == 2


def test_heap_is_given_back(spark):
    from trailmark.llm.common import give_back_heap

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = [b for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName()]
    before = sum(b.getCollectionCount() for b in full)
    give_back_heap(spark)
    assert full and sum(b.getCollectionCount() for b in full) > before


def test_stages_begin_by_giving_heap_back(spark, monkeypatch):
    begun = []
    monkeypatch.setattr(corpus_pipeline, "give_back_heap", lambda s: begun.append(s))
    docs = spark.createDataFrame([(1, "one two three four five six", "a")], "doc_id long, text string, source string")
    for _, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, "")
    assert len(begun) == len(corpus_pipeline.STAGES) - 1


def test_the_driver_collects_where_its_heap_has_grown(spark, monkeypatch):
    from types import SimpleNamespace

    from trailmark.llm import common

    asked = []

    def driver(total, most):
        runtime = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: most)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=SimpleNamespace(gc=lambda: asked.append(total)))
        return SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))

    for total in (300, 375, 376, 700):
        common.collect_on_driver(driver(total, 750))
    assert asked == [376, 700]
    monkeypatch.setattr(common, "collect_on_driver", asked.append)
    assert common.written(spark.range(3), "three").count() == 3
    assert len(asked) == 3


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trailmark.llm import common

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    narrow = common.written(spark.range(100), "narrow")
    wide = common.written(spark.range(100).select(*[F.col("id").alias(f"c{i}") for i in range(12)]), "wide")
    assert common.broadcast_rows(wide) < common.broadcast_rows(narrow) <= common.BROADCAST_ROWS
    assert hinted(common.small(narrow)) and hinted(common.small(wide)) and not hinted(common.small(narrow, 99))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 15_000)
    assert hinted(common.small(narrow)) and not hinted(common.small(wide))


def test_classes_beyond_the_bound_are_shuffled_with_the_same_result(spark, monkeypatch):
    from trailmark.llm import common, jaccard

    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base, "tail"]), " ".join(f"v{i}" for i in range(60)), "one two", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = sorted(jaccard.jaccard_components(docs).collect())
    assert [r.component_id for r in before] == [0, 0, 0, 3, 4, 5, 6]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(jaccard.jaccard_components(docs).collect()) == before
