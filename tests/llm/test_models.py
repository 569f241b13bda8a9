import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrat.llm import brown_lm, divergence_rules, host_paths, pu_toxicity
from quadrat.llm.common import words
from quadrat.llm.queries import quality_sql
from tests.llm.helpers import frame, rows, sentence


def test_language_model_counts(spark):
    data = rows()
    got = {r.doc_id: r for r in brown_lm.score(frame(spark, data), F.col("doc_id") % 5 != 1).collect()}
    tokens = {i: [*words((t or "").encode()), None] for i, t in data}
    counts = Counter(w for i, own in tokens.items() if i % 5 != 1 for w in own)
    total, types = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            i % 5 == 1, len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    assert brown_lm.score(frame(spark, data).limit(0), F.lit(True)).count() == 0
    nothing = brown_lm.score(frame(spark, data[:5]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0.0 for r in nothing)


def test_language_model_is_a_distribution(spark):
    """Over all known words and one unseen word per class, what may follow sums to one."""
    rng = random.Random(2)
    data = [(i, sentence(rng, 25)) for i in range(60)]
    vocabulary = sorted({w for _, t in data for w in words(t.encode())})
    asked = [(1_000 + i, w.decode()) for i, w in enumerate(vocabulary)]
    got = brown_lm.score(frame(spark, data + asked + [(999, "")]), F.col("doc_id") < 999)
    score = {r.doc_id: r.score for r in got.collect()}
    # P(word, end) <= P(word) and P(end) is the score of the empty text
    assert 10 ** score[999] + sum(10 ** score[i] for i, _ in asked) < 1


def test_rare_words_are_classed_by_their_neighbours(spark, monkeypatch):
    """Words beyond the most frequent share an ending; only what stands around them tells two kinds apart."""
    monkeypatch.setattr(brown_lm, "HEAD", 6)
    kinds = [("red", "a", "fox", "barks"), ("blue", "b", "wren", "sings")]
    data = [(100 * k + i, f"{before} {often if i % 3 == 0 else f'{name}{i % 20:02d}qqq'} {after}")
            for k, (before, name, often, after) in enumerate(kinds) for i in range(60)]
    asked = [(1_000, "red a07qqq barks"), (1_001, "red b07qqq barks"), (1_002, "blue b07qqq sings"), (1_003, "blue a07qqq sings")]
    got = {r.doc_id: r for r in brown_lm.score(frame(spark, data + asked), F.col("doc_id") < 1_000).collect()}
    assert all(got[i].n_known == 4 for i, _ in asked)
    assert got[1_000].score > got[1_001].score + 1 and got[1_002].score > got[1_003].score + 1


def test_best_class_takes_the_word_out_of_its_own():
    """The step is the exchange criterion: nothing is gained by staying with one's own counts alone."""
    table = np.zeros((4, 4))
    table[1, 2], table[2, 1], table[1, 3], table[3, 1], table[0, 1], table[1, 0] = 50, 50, 4, 4, 9, 9
    before = after = np.array([[0, 4, 0, 0], [0, 0, 0, 0]], float)  # all of class 3 is this word
    assert brown_lm.best_classes(before, after, np.array([3, 3]), table).tolist() == [2, 3]


def test_exchange_finds_the_blocks():
    rng = np.random.default_rng(1)
    pairs = np.zeros((21, 21), np.int64)
    for s in range(1, 21):  # even symbols are followed by odd ones and the other way round
        for t in range(1, 21):
            if s % 2 != t % 2:
                pairs[s, t] = rng.integers(20, 60)
    pairs[0, 1:] = pairs[1:, 0] = 1
    of = brown_lm.exchange(pairs, 3)
    assert of[0] == 0 and len({of[s] for s in range(1, 21, 2)}) == 1 and len({of[s] for s in range(2, 21, 2)}) == 1
    assert of[1] != of[2]


def test_exchange_never_lowers_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(rng.gamma(0.3, 3, (30, 30)))

    def likelihood(of):
        member = np.eye(6)[of]
        table = member.T @ pairs @ member
        return brown_lm.x_log_x(table).sum() - brown_lm.x_log_x(table.sum(0)).sum() - brown_lm.x_log_x(table.sum(1)).sum()
    values = [likelihood(brown_lm.exchange(pairs, 6, rounds)) for rounds in range(4)]
    assert all(a <= b + 1e-6 for a, b in zip(values, values[1:]))


def toxic_rows():
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        text = sentence(rng, rng.randint(5, 80)).split()
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["wretchx", "vilestus", "cursedly"]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_features_are_counted_in_slices(spark):
    """Counts of features over slices add up to those of all texts; a slice gives two rows a feature at most."""
    sample = [(b"red fox", 1), (b"red red dog", 0), (b"", 0), (b"fox", 1)] * 400
    frame_ = spark.createDataFrame([(bytearray(t), p) for t, p in sample], "text binary, positive int").coalesce(1)
    got = frame_.mapInArrow(pu_toxicity.count_features, "code long, p long, u long").groupBy("code").sum("p", "u").collect()
    want = {f: [sum(p == k for t, p in sample if f in pu_toxicity.text_features(t)) for k in (1, 0)]
            for t, _ in sample for f in pu_toxicity.text_features(t)}
    assert {r.code: [r[1], r[2]] for r in got} == want


def test_pipeline_sends_small_batches(spark, tmp_path):
    docs, labels = toxic_rows()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.toxicity(spark, frame(spark, [(i, t * 40) for i, t in docs]).coalesce(1), str(tmp_path)).count()
    size = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("x"), 20_000).alias("text")).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    assert max(r.n for r in size.collect()) <= 2 * corpus_pipeline.BATCH_BYTES


def test_toxicity(spark):
    docs, labels = toxic_rows()
    table = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 5 != 1
    model = pu_toxicity.fit(frame(spark, docs), table, learn)
    got = {r.doc_id: r.score for r in pu_toxicity.score(frame(spark, docs + [(900, None), (901, "")]), model).collect()}
    held = [i for i, _ in docs if i % 5 == 1]
    assert all((got[i] >= 0.7) == (i % 8 == 0) for i in held)
    assert got[900] == got[901] < 0.7
    assert pu_toxicity.fit(frame(spark, docs), table.limit(0), learn) is None
    assert {r.score for r in pu_toxicity.score(frame(spark, docs[:3]), None).collect()} == {0.0}
    assert pu_toxicity.score(frame(spark, docs).limit(0), model).count() == 0


def test_toxicity_with_a_hot_text(spark):
    rng = random.Random(14)
    marks = [f"{a}{b}word" for a in ("wretch", "vilest", "cursed", "foulest", "brutish") for b in "qwxyz"]
    hot = " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(150))
    docs, labels = [], []
    for i in range(3_000):
        text = sentence(rng, 30)
        if i % 4 == 0:
            text = hot if i % 12 == 0 else f"{text} {marks[i // 4 % 25]} {sentence(rng, 9)}"
        docs.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 5 != 1
    model = pu_toxicity.fit(frame(spark, docs), table, learn)
    got = {r.doc_id: r.score for r in pu_toxicity.score(frame(spark, docs), model).collect()}
    held = [i for i, _ in docs if i % 5 == 1]
    assert sum(got[i] >= 0.7 for i in held if i % 4 == 0 and i % 12) >= 0.95 * sum(i % 4 == 0 and i % 12 > 0 for i in held)
    assert sum(got[i] >= 0.7 for i in held if i % 4) <= 0.02 * len(held)


def test_non_negative_risk_holds():
    rng = np.random.default_rng(5)
    positive = (rng.random((80, 12)) < 0.1) | (np.arange(12) < 2)
    unlabelled = rng.random((600, 12)) < 0.1
    unlabelled[:60, :2] = True
    weight, bias = pu_toxicity.nn_pu_fit(positive, unlabelled, 0.1)
    assert weight[:2].sum() + bias > 0 > bias and np.abs(weight[2:]).max() < weight[:2].min()


def check_quality(spark, data):
    docs = frame(spark, data)
    got = divergence_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    con = duckdb.connect()
    con.register("documents", docs.toPandas()[["doc_id", "text", "lang"]])
    want = con.sql(quality_sql()).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    return {r.doc_id: r for r in got.collect()}


def test_quality_rules_match_sql(spark):
    rng = random.Random(8)
    line = sentence(rng, 12)
    data = rows() + [(500, f"{line}\n{line}\n \n{line}"), (501, "#$% " * 60), (502, "one two three four five " * 5),
                     (503, " ".join(w + "%%%" for w in sentence(rng, 150).split())), (504, sentence(rng, 150).upper())]
    got = check_quality(spark, data)
    assert got[500].n_dup_lines == 2 and got[502].n_repeat_words == 25 and got[502].base_failed
    assert not got[503].kept and got[501].n_symbols == 180
    assert divergence_rules.judge(frame(spark, data).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">menu entry that is long enough</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad-{n}">buy this now, buy it</div><div class="cookie-notice">we use cookies</div>
<article class="post p{n}"><h1>Title &amp; more</h1><p>First&nbsp;block <b>bold</b><br>next
line.<p>Second block.</p><form>name</form><div class="share">share it</div></article>
<aside>side</aside><div class="comments"><p>a reader says a lot of things here that are long enough to win</p></div>
<footer>&copy; end</footer></body></html>"""


def test_pages(spark):
    odd = ["", None, "plain text & more", "<p>unclosed <b>tags", "<div><p>x</p></div></div></body>", "<a title='x>y</a> z",
           "<" * 500, "<script>never closed <p>no", "<p>" + "word " * 20_000]
    pages = [(i, f"https://h{i % 2}.example/{i}", PAGE.replace("{n}", str(i)), "clash") for i in range(6)]
    pages += [(100 + i, [None, "no url", "https://h0.example/x"][i % 3], p, "clash") for i, p in enumerate(odd)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in host_paths.extract(table).collect()}
    for i in range(6):
        assert got[i].text == "Title & more\n\nFirst block bold next line.\n\nSecond block."
    assert got[100].text == got[101].text == "" and got[102].text == "plain text & more"
    assert got[103].text == "unclosed tags" and got[104].text == "x"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    assert host_paths.extract(table.limit(0)).count() == 0


ARTICLE = "<p>" + "This is the story text of the article with many words in it. " * 8 + "</p>"
SIDE = "<div class='sidebar'><p>Side words here for all.</p></div>"


@pytest.mark.parametrize("page", [
    f"<body><div class='layout has-sidebar'>{ARTICLE}{SIDE}</div></body>",
    f"<body><div id='page-no-sidebar'>{ARTICLE}{SIDE}</div></body>",
    f"<body><div class='elementor-widget-theme-post-content'>{ARTICLE}</div>{SIDE}</body>",
    f"<body><form id='f'><div>{ARTICLE}{SIDE}</div></form></body>",
    f"<body><div class='widget-area'><div class='x'>{ARTICLE}</div>{SIDE}</div></body>",
    f"<body><div>{ARTICLE}</div><div class='cookie-notice'>{'We use cookies on this page. ' * 9}</div></body>",
    f"<body><div>{ARTICLE}</div><div id='comments'><article>{ARTICLE * 30}</article></div></body>",
    f"<body><button type=submit><div>{ARTICLE}</div>",
    f"<body><div>{ARTICLE}</div><script>var x = '<p>no</p>'</SCRIPT >{SIDE}</body>"])
def test_wrappers_named_like_furniture(page):
    found = host_paths.read_page(page)
    assert host_paths.text_at(found, host_paths.best_path(found)[0]) == " ".join(ARTICLE[3:-4].split())


def test_pages_of_furniture_only_and_letters_that_grow():
    for page in (f"<div class='sidebar'>{'short '*9}</div>", f"<nav>{ARTICLE}</nav>", f"<div id='comments'>{ARTICLE}</div>", f"<footer>{ARTICLE}</footer>"):
        found = host_paths.read_page(page)
        assert host_paths.text_at(found, host_paths.best_path(found)[0]) in (None, "")
    found = host_paths.read_page("<p>" + "\u0130" * 30 + "</p><script>x</script><p>Start of the article text here</p>")
    assert host_paths.text_at(found, "") == "\u0130" * 30 + "\n\nStart of the article text here"


def test_open_cells_and_divisions_take_little_memory():
    import tracemalloc
    for page, most in (("<table>" + "<tr><td>cell text" * 20_000, 60e6), ("<div class='box'>x " * 4_000, 20e6)):
        tracemalloc.start()
        found = host_paths.read_page(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most and len(found) > 4_000
    assert max(c.path.count("/") for c in found) == 0


def test_host_vote_overrules_a_page(spark):
    body = "<body><div class='story'><p>{a}</p></div><div class='box'><p>{b}</p></div></body>"
    pages = [(i, "http://one.example/", body.format(a="long text " * 20, b="short")) for i in range(5)]
    pages.append((9, "http://one.example/", body.format(a="brief", b="a much longer box " * 20)))
    got = {r.page_id: r.text for r in host_paths.extract(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief"


def test_pipeline(spark, tmp_path):
    docs, labels = toxic_rows()
    docs += [(1_000 + i, t) for i, t in rows(30)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, columns = {i for i, _ in docs}, table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == columns, name
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in table.collect()}
        assert now <= left
        left = now
    placed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == left
    assert not {i for i, _, bad in labels if bad and i % 3 == 2} & left
