import numpy as np
import pytest
from landmarq.llm import langid
from pyspark.sql import functions as F

WORDS = {"en": "the of and to in is that it was for on are with as his they at be this from", "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch", "fr": "de la le et les des en un du une que est pour qui dans au par plus pas sur"}


def texts(n, seed):
    random = np.random.default_rng(seed)
    return [(lang, " ".join(random.choice(WORDS[lang].split(), random.integers(5, 40)))) for lang in WORDS for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, lang if i % 4 else None, f"{lang}host" if i % 5 else None) for i, (lang, t) in enumerate(texts(60, 1))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy(spark, rows):
    """Rows without a declaration train nothing; their language is known from how they were made."""
    truth = {i: lang for i, (lang, _) in enumerate(texts(60, 1))}
    got = langid.identify_documents(rows).where("lang is null").collect()
    assert len(got) == 45 and sum(r.language == truth[r.doc_id] for r in got) >= 44


def test_evidence_meets(spark, rows):
    """A text that says little goes by its host; a declaration that is as a rule right helps too."""
    more = spark.createDataFrame([(1000, "in", None, "dehost"), (1001, "in", None, "enhost"), (1002, "en de", "fr", None), (1003, None, "de", "dehost"), (1004, "12 34 !!", "de", "dehost")], rows.schema)
    got = {r.doc_id: r for r in langid.identify_documents(rows.union(more)).collect()}
    assert (got[1000].language, got[1001].language, got[1002].language) == ("de", "en", "fr")
    assert not got[1003].accepted and not got[1004].accepted and got[1004].language == langid.UNKNOWN


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = langid.identify_pages(pages).withColumn("said", F.regexp_extract("html", 'lang="([a-z]+)', 1)).collect()
    assert len(got) == pages.count() and sum(r.language == r.said for r in got) >= 0.98 * len(got)


def test_addresses(spark):
    frame = spark.createDataFrame([("https://u:p@A.Example.CO:8080/x?y",), ("ftp://h/",), ("nothing",), (None,)], "url string")
    got = frame.select(langid.host_of(F.col("url")).alias("h")).select("h", langid.suffix_of(F.col("h")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("a.example.co", "co"), ("h", None), (None, None), (None, None)]


def test_markup(spark):
    html = "<!-- x --><html  class='a' lang='de-AT'><script>var a='<p>';</script><p>Hallo&nbsp;Welt</p></html>"
    r = spark.createDataFrame([(html,)], "h string").select(langid.markup_language(F.col("h")).alias("l"), langid.markup_text(F.col("h")).alias("t")).first()
    assert r.l == "de" and r.t.split() == ["Hallo", "Welt"]


def test_one_text_repeated_trains_its_language(spark):
    """9,000 rows of one text and a few of another language: both have a model, and equal texts count once."""
    rows = [("zu " * 30, "de")] * 9000 + [(f"the {'of ' * (i + 3)}", "en") for i in range(40)]
    model = langid.train(spark.createDataFrame(rows, "text string, declared string"), 20)
    assert model.languages == ["de", "en"]
    de, en = model.score(b"zu zu zu")[:2], model.score(b"the of of")[:2]
    assert de[0] > de[1] and en[1] > en[0]
    once = langid.train(spark.createDataFrame([*rows[:12], *rows[9000:]], "text string, declared string"), 20)
    assert (once.table == model.table).all()


def test_the_sample_is_bounded(spark):
    """Of 300 distinct texts 50 train, the same ones whatever the order and the repeats."""
    rows = [(f"w{i} " * 5, "xx") for i in range(300)]
    table = lambda given: langid.train(spark.createDataFrame(given, "text string, declared string").repartition(3), 50).table
    whole = table(rows)
    assert (whole == table(rows[::-1] * 2)).all()
    wide = langid.train(spark.createDataFrame(rows, "text string, declared string"), 300).table
    assert (whole != wide).any()


def test_priors_and_fusion_by_hand(spark, rows):
    """Posteriors worked out row by row from the definition: likelihoods, own share left out, host over suffix over all, declarations."""
    data = rows.withColumn("suffix", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    got = {r.doc_id: r for r in langid.identify(data, "text", F.col("lang"), F.col("source"), F.col("suffix")).collect()}
    model = langid.train(data.select("text", F.col("lang").alias("declared")))
    size = len(model.languages) + 1
    start = np.log(np.r_[np.full(size - 1, (1 - langid.UNKNOWN_PRIOR) / (size - 1)), langid.UNKNOWN_PRIOR])
    rows = data.collect()
    like = {r.doc_id: model.score(r.text.encode()) for r in rows}
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    own = {i: soft(v + start) for i, v in like.items()}
    sums = lambda test: sum((own[r.doc_id] for r in rows if test(r)), np.zeros(size))
    total = sums(lambda r: True)
    whole = (total + 1) / (total + 1).sum()
    said = {k: sums(lambda r, k=k: r.lang == k) for k in {r.lang for r in rows}}
    for r in rows:
        suffix = sums(lambda o, r=r: o.suffix == r.suffix)
        above = (suffix + langid.SUFFIX_SMOOTHING * whole) / (suffix.sum() + langid.SUFFIX_SMOOTHING)
        others = np.maximum(sums(lambda o, r=r: (o.source, o.suffix) == (r.source, r.suffix)) - own[r.doc_id], 0) if r.source else np.zeros(size)
        prior = np.log((others + langid.HOST_SMOOTHING * above) / (others.sum() + langid.HOST_SMOOTHING))
        heard = np.log((said[r.lang] + 1) / (total + len(said) + 1)) if r.lang else 0
        want = soft(like[r.doc_id] + prior + heard)
        assert got[r.doc_id].language == [*model.languages, langid.UNKNOWN][int(want.argmax())]
        assert got[r.doc_id].confidence == pytest.approx(want.max(), rel=1e-6)


def test_a_language_without_a_model_is_taken_at_its_word(spark, rows):
    odd = spark.createDataFrame([(2000, "qqzx jjvk xqwz kkjq " * 20, "tlh", None), (2001, "the of and to in is that it was for " * 5, "tlh", None), (2002, "qqzx jjvk xqwz kkjq " * 20, None, None)], rows.schema)
    got = {r.doc_id: (r.language, r.accepted) for r in langid.identify_documents(rows.union(odd)).collect()}
    assert got[2000] == ("tlh", True) and got[2001] == ("en", True) and got[2002] == (langid.UNKNOWN, False)


def test_odd_rows(odd_docs, no_docs, rows):
    few = langid.identify_documents(odd_docs).collect()
    assert len(few) == odd_docs.count() and {r.language for r in few} == {langid.UNKNOWN}
    both = rows.unionByName(odd_docs, allowMissingColumns=True)
    kept = langid.accepted_documents(both)
    assert kept.columns == both.columns
    assert kept.where("doc_id < 1000 and fp is null").count() == rows.count()
    assert langid.identify_documents(no_docs).count() == 0 and langid.accepted_documents(no_docs).columns == no_docs.columns
