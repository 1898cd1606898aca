"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns: for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veinwork.llm import decontaminate, exact_dedup, html_text, language_model, licenses, near_dedup, packing, pii, secrets, toxicity
from veinwork.llm.queries import byte_bpe

LONG = " ".join(f"w{i % 9973} lorem{i % 31}" for i in range(60_000))
BODY = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long while in the warm sun"
ROWS = [(1, ""), (2, None), (3, BODY), (4, BODY), (4, BODY), (None, "a text without an id"), (None, None), (5, LONG), (6, "x"), (7, "ßİ ﬀ 日本語 \x00\t\x0b")]
CLASHING = ("id", "row", "hash", "lead", "rep", "sig", "n", "set_key", "start", "part", "n_tokens", "spans", "score", "kept", "keep_id", "component_id", "item", "sha", "edge", "label", "_id", "_sha256", "_sha", "_text_sha0", "item_row", "width", "text_sha", "seeds")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, nothing):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert by[3] == [(3, 3, True)] and by[4] == [(3, 3, False)] * 2
    assert by[1] == [(1, 3, True)] and by[2] == [(1, 3, False)]  # null counts as empty
    assert sorted(by[None], key=str) == sorted([(1, 3, False), (None, 1, True)], key=str)  # a null id stays only where it is alone
    assert {r.text_sha256 for r in got if r.doc_id == 5} == {hashlib.sha256(LONG.encode()).hexdigest()}
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs, keep="max").filter("doc_id = 3").collect()} == {4}
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, keep="first")


def test_near_dedup(docs, nothing):
    got = {}
    for r in near_dedup.near_components(docs, k=2).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)]
    assert got[3] == [(21, 3, True)] and got[4] == [(21, 3, False)] * 2
    assert got[6] == [(1, 6, True)]
    assert all(c is None for _, c, _ in got[None]) and len(got[None]) == 2
    assert got[5][0][1:] == (5, True)
    assert near_dedup.near_components(nothing).count() == 0


def test_packing(docs, nothing):
    got = packing.pack_pieces(docs, byte_bpe(), width=64).collect()
    assert sorted((r.doc_tokens, r.length) for r in got if r.doc_id in (1, 2)) == [(1, 1), (1, 1)]
    assert sum(r.length for r in got if r.doc_id == 4) == 2 * next(r.doc_tokens for r in got if r.doc_id == 4)
    assert packing.pack_pieces(nothing, byte_bpe()).count() == 0
    assert packing.pack_sequences(nothing, byte_bpe()).count() == 0


def test_language_model(docs, nothing, spark):
    rows = language_model.score(docs, F.coalesce("doc_id", F.lit(0)) != 6).collect()
    assert len(rows) == len(ROWS)  # repeated and missing ids keep their rows
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.score, r.base_score))
    assert got[1] == got[2] and got[1][0][0] == 1
    assert got[6][0][:2] == (2, 1)
    assert sorted(n for n, *_ in got[None]) == [1, 6]
    assert got[4][0] == pytest.approx(got[3][0]) and got[4][1] == pytest.approx(got[3][0])
    two = spark.createDataFrame([(1, "a"), (1, "a b c"), (None, "a"), (None, "b b")], "doc_id long, text string")
    parts = language_model.score(two, F.lit(True)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in parts) == [("1", 2), ("1", 4), ("None", 2), ("None", 3)]
    assert language_model.score(nothing, F.lit(True)).count() == 0
    unknown = language_model.score(docs, F.lit(None).cast("boolean")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in unknown)


def test_toxicity(docs, nothing, spark):
    model = toxicity.fit(docs, labels(spark, []))
    assert all(r.score == 0.5 for r in toxicity.score(docs, model).collect())
    one_kind = toxicity.fit(docs, labels(spark, [(3, 1, 0), (5, 1, 0), (6, 1, None), (None, 1, 1)]))
    assert all(r.score < 0.5 for r in toxicity.score(docs, one_kind).collect())
    assert toxicity.score(nothing, one_kind).count() == 0
    assert toxicity.keep_clean(docs, one_kind).count() == len(ROWS)
    assert toxicity.keep_clean(nothing, one_kind).columns == docs.columns


def test_decontamination(docs, nothing, spark):
    bench = spark.createDataFrame([(1, BODY), (2, None), (3, ""), (4, "too short"), (1, BODY)], "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHING})
    got = [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.find_contamination(docs, bench).collect()]
    assert sorted(got) == [(3, 1, 1.0)] * 2 + [(4, 1, 1.0)] * 4  # a repeated document or item gives its pairs each
    assert decontaminate.find_contamination(nothing, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("scan", [licenses.scan_licenses, secrets.scan_secrets, pii.scan_pii])
def test_scans(docs, nothing, scan):
    got = scan(docs).collect()
    if scan is licenses.scan_licenses:
        assert got == []
    else:
        assert len(got) == len(ROWS) and all(len(r.spans) == 0 for r in got)
    assert scan(nothing).count() == 0


def test_html(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>" + LONG), (3, "u", "<p>" + LONG), (None, "u", "<<<>>&#0;</"), (4, "u", "<div>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "kept_0", "text", "n_chars")})
    got = html_text.extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    labels(spark, [(3, 1, 0), (5, 1, 0)]).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item that no document here holds at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, nothing, sf_dir, name, stage):
    got = stage(spark, docs, sf_dir)
    if name != "packing":
        assert got.columns == docs.columns
        assert all(set(r) == {"clash"} for r in got.select(*CLASHING).collect())
        assert stage(spark, nothing, sf_dir).count() == 0
    rows = got.select("doc_id").collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    if name in ("toxicity", "decontamination"):
        assert len(ids) == len(ROWS)
    if name == "exact dedup":
        assert ids == sorted([1, 3, 5, 6, 7, None], key=str)
    if name == "near dedup":
        assert ids == sorted([1, 2, 3, 5, 6, 7, None, None], key=str)
    if name == "packing":
        assert set(ids) == {i for i, _ in ROWS}


def test_stages_take_string_ids(spark, docs, sf_dir):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES:
        want, got = ([r.doc_id for r in stage(spark, d, sf_dir).select("doc_id").collect()] for d in (docs, named))
        assert sorted(got, key=str) == sorted((i if i is None else f"d{i}" for i in want), key=str), name


GOOD = "The cat sat on the mat and it was the best of all the days that a cat has in a house with a view of the sea."


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div class="content with-sidebar">', "</div>"),
        ('<article class="post comments-open">', "</article>"),
        ('<div id="menu-page-wrapper"><main>', "</main></div>"),
        ('<form action="/">', "</form>"),
        ('<form><div class="ad-page"><article>', "</article></div></form>"),
    ],
)
def test_marked_containers_keep_the_article(before, after):
    article = f"<h1>Head</h1><p>{GOOD} 1</p><p>{GOOD} 2</p><div class='comments'><p>{GOOD} 3</p></div><p>{GOOD} 4</p>"
    page = f'<html><body><nav>{GOOD}</nav>{before}{article}{after}<div class="related"><p>{GOOD} 5</p></div><footer>{GOOD}</footer></body></html>'
    assert html_text.main_text(page) == f"Head\n{GOOD} 1\n{GOOD} 2\n{GOOD} 4"


def test_comments_beside_an_article_stay_out():
    page = f'<body><div class="content"><p>{GOOD}</p><p>{GOOD}</p></div><div id="comments"><p>{GOOD}</p></div><form><p>{GOOD}</p></form></body>'
    assert html_text.main_text(page) == f"{GOOD}\n{GOOD}"


@pytest.mark.parametrize(
    ("text", "iban"),
    [
        ("DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
        ("DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013000 12.05.2024", "DE89370400440532013000"),
        ("AB12 DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013001 BIC COBADEFFXXX", None),
    ],
)
def test_iban_followed_by_other_words(text, iban):
    assert [text[a:b] for k, a, b, _ in pii.find_pii(text) if k == "iban"] == ([iban] if iban else [])


def test_labels_whose_ids_repeat_are_learned_from(spark):
    """Many labels of few ids, whose hashes all lie high: the first max_rows of them are used, as of any other table."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = spark.range(1000).withColumnRenamed("id", "doc_id").filter(place > 0.7 * (1 << 30)).orderBy(place).limit(40)
    docs = ids.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "awful nasty words").otherwise("kind gentle words").alias("text")).cache()
    labels = ids.crossJoin(spark.range(2500).select()).select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, max_rows=60_000)
    assert model.weights and model.score("awful nasty words") > 0.5 > model.score("kind gentle words")
