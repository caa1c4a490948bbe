"""The pipeline's stages over rows without an id and rows that share one."""

from collections import Counter

import corpus_pipeline
from quernel.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE, FR, ES = "the cat and the dog in the park", "der hund und die katze im park", "le chat et le chien dans le parc", "el gato y el perro en el parque"
TEXTS = {"en": EN, "de": DE, "fr": FR, "es": ES}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], SCHEMA)


def test_mix_keeps_rows_without_id_and_rates_each_row(spark, tmp_path):
    rows = [(10 * k + j, f"{t} {j}", lang) for k, (lang, t) in enumerate(TEXTS.items()) for j in range(10)]
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [(None, f"{EN} {j}", "en") for j in range(20)] + [(None, f"{FR} {j}", "fr") for j in range(4)] + [(500, f"{DE} twice", "de"), (500, None, "en")]
    out = Counter(corpus_pipeline.mix(spark, frame(spark, rows), str(tmp_path)).collect())
    got = Counter()
    for r, n in out.items():
        got[r.doc_id is None, r.lang] += n
    assert got[True, "en"] > 0 and got[True, "fr"] > 0
    docs = frame(spark, rows)
    assert set(out) <= set(docs.collect())
    rates = corpus_pipeline.mixing.rates(docs, queries.labelled_languages(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), queries.TARGETS).collect()
    own = {r.n_tokens: r.copies for r in rates if r.doc_id == 500}
    for t in (f"{DE} twice", None):
        assert sum(n for r, n in out.items() if r.doc_id == 500 and r.text == t) == own[len((t or "").split())]


def test_dedup_of_repeated_rows_and_rows_without_id(spark):
    long = " ".join(f"word{k}" for k in range(60))
    near = long + " more"
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(5, long, "en")] * 3 + [(None, long, "en")] * 2 + [(None, near, "en"), (7, near, "en")]
    rows += [(None, other, "en")] * 3 + [(None, other + " end", "en"), (9, "alone here", "en"), (9, "something else", "en"), (None, None, "en"), (None, None, "en"), (11, "", "en"), (12, "", "en")]
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, frame(spark, rows), "").collect())
    kept = [t for i, t in out.elements() if i is None and t and t.startswith("other")]
    assert len(kept) == 1
    out.subtract([(None, kept[0])])
    assert +out == Counter([(5, long), (9, "alone here"), (9, "something else"), (None, None), (11, ""), (12, "")])
