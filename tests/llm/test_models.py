from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from rollbook.llm.html_extraction import Page, decode, extract, features, trained, training_pages
from rollbook.llm.language_id import BASE, identify, packed_grams, train_models
from rollbook.llm import lm_scoring
from rollbook.llm.lm_scoring import MASKED, OFFSETS, Network, Trainer, Vocabulary, masked, score, train, windows, word_counts, words_of
from rollbook.llm.quality import classify, fit, quality_stage, site_columns, site_posteriors

LANGS = {"en": "the quick brown fox jumps over the lazy dog and runs away from the town ", "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg ", "es": "el rápido zorro marrón salta sobre el perro perezoso y huye del pueblo "}


def lang_rows():
    out = []
    for k, (lang, text) in enumerate(LANGS.items()):
        w = text.split()
        out += [(100 * k + i, " ".join(w[(i * j + k) % len(w)] for j in range(12)), lang) for i in range(60)]
    return [*out, (900, None, "en"), (901, "", "de"), (902, "12 345 !!", None), (903, "the dog", None), (0, "the quick brown fox", "en"), (904, "x" * 200_000, "en")]


def test_language_held_out(frame):
    rows = lang_rows()
    got = identify(frame(rows), F.col("doc_id") % 5 == 0).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 20 and all(r.lang_pred == want[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    none = {r.doc_id: r for r in got if r.doc_id in (900, 901, 902)}
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in none.values())
    assert next(r for r in got if r.doc_id == 903).lang_pred == "en"


def test_language_models_sum_to_one(frame):
    m = train_models(frame([(1, "ab ab abc", "x"), (2, "cab bab", "x")]))
    seen, _ = packed_grams(["ab ab abc", "cab bab"])
    last = np.unique(seen & np.uint64(0xFFFF))
    for ctx in np.unique(seen >> np.uint64(16))[:5]:
        p = np.exp(-m.surprise((np.uint64(ctx) << np.uint64(16)) | np.append(last, np.uint64(0x4E00))).astype(float))[:, 0]
        assert abs(p[:-1].sum() + p[-1] * (1 / BASE - len(last)) - 1) < 1e-3


def plain_kneser_ney(texts, order=4):
    """log p of the last character of a gram, by dictionaries and the textbook's recursion."""
    grams: dict[str, int] = {}
    for t in texts:
        s = "   " + t
        for i in range(order - 1, len(s)):
            g = s[i - order + 1 : i + 1]
            grams[g] = grams.get(g, 0) + 1
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        c: dict[str, int] = {}
        for g in levels[k + 1]:
            c[g[1:]] = c.get(g[1:], 0) + 1
        levels[k] = c

    def p(g, k):
        if k == 0:
            return BASE
        c, ctx = levels[k], g[-k:-1]
        n1, n2 = (sum(1 for v in c.values() if v == x) for x in (1, 2))
        d = max(0.1, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5)
        own = [v for x, v in c.items() if x[:-1] == ctx]
        if not own:
            return p(g, k - 1)
        return max(c.get(g[-k:], 0) - d, 0) / sum(own) + d * len(own) / sum(own) * p(g, k - 1)

    return lambda g: float(np.log(p(g, order)))


def test_language_models_against_plain_kneser_ney(frame):
    texts = ["the cat sat on the mat", "a cat and a hat", "that hat is that cat s"]
    m = train_models(frame([(i, t, "x") for i, t in enumerate(texts)]))
    want = plain_kneser_ney(texts)
    seen, _ = packed_grams([*texts, "the zebra hats"])
    for g in np.unique(seen):
        text = "".join(chr(int(g) >> s & 0xFFFF) for s in (48, 32, 16, 0))
        assert abs(-m.surprise(np.array([g]))[0, 0] - want(text)) < 1e-4


def test_language_cutoffs_bound_the_models(frame):
    docs = frame(lang_rows())
    whole, cut = train_models(docs), train_models(docs, entries=400)
    assert len(cut.keys) <= 800 < len(whole.keys)
    got = [cut.langs[int(cut.entropies([t])[0][0].argmin())] for t in LANGS.values()]
    assert got == list(LANGS)


def test_language_nothing_to_learn(frame):
    assert {r.lang_pred for r in identify(frame([(1, "abc", None), (2, None, None)]), F.lit(False)).collect()} == {"und"}
    assert identify(frame([]), F.lit(False)).count() == 0


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def junk(k):
    return "!!! ".join(w.upper() + "###" for w in prose(k, 60).split())


def test_quality_separates_and_shrinks(frame, labels):
    rows = [(i, prose(i, 80) if i % 3 else junk(i), "en", f"src{i % 4}") for i in range(150)] + [(900, None, None, None), (901, "", "en", "lone"), (3, junk(3), "en", "src3")]
    marks = labels([(i, int(i % 3 > 0), 0, "clash") for i in range(100)] + [(900, None, 0, "")])
    got = {r.doc_id: r for r in classify(frame(rows), marks).collect()}
    assert len(got) == 152
    assert all(got[i].kept == (i % 3 > 0) for i in range(100, 150))
    kept = classify(frame(rows), marks, keep_columns=True)
    assert kept.columns == frame([]).columns and all(r.doc_id % 3 for r in kept.collect() if r.doc_id < 150)


def test_quality_without_labels_or_rows(frame, labels):
    assert classify(frame([]), labels([])).count() == 0
    assert classify(frame([(1, "a b", "en", "s"), (2, None, None, None)]), labels([])).count() == 2
    assert classify(frame([(1, "a b", "en", "s")]), labels([(1, 1, 0, "")])).count() == 1


def test_site_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "/a", 0.0, 1 if i % 10 else 0) for i in range(200)] + [("bad", "/a", 0.0, 1 if i % 10 == 0 else 0) for i in range(200)] + [("tiny", "/a", 0.0, 0)] + [("tiny", "/b", 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id long, _host string, _path string, _llr double, _y int")
    for limit in (1, 100):  # joined by a shuffle, and by broadcast
        out = {r._id: r for r in site_posteriors(df, 0.5, broadcast_rows=limit).collect()}
        assert len(out) == len(rows)
        assert out[0].path_rate > 0.8 and out[200].path_rate < 0.2 and 0.05 < out[401].path_rate < 0.5


def test_posteriors_equal_brute_force(spark):
    """Hosts of a hundred rows and of one, paths within; half of the rows labelled."""
    r = random.Random(3)
    rows = []
    for h in range(60):
        good = r.random()
        for _ in range(r.choice((1, 2, 3, 40, 100))):
            y = int(r.random() < good)
            rows.append((len(rows), f"h{h}", f"p{r.randrange(3)}", r.gauss(2 * y - 1, 1.5), y if r.random() < 0.5 else None))
    prior = 0.4
    known = [float(y) if y is not None else 1 / (1 + math.exp(-(llr + math.log(prior / (1 - prior))))) for *_, llr, y in rows]

    def sums(key):
        out: dict = {}
        for row, e in zip(rows, known, strict=True):
            k, n = out.get(key(row), (0.0, 0))
            out[key(row)] = (k + e, n + 1)
        return out

    def worth(sites, rate):
        between = sum(n * (k / n - rate(s)) ** 2 for s, (k, n) in sites.items())
        within, total = (sum(w(n) * rate(s) * (1 - rate(s)) for s, (_, n) in sites.items()) for w in (lambda n: 1, lambda n: n))
        return 1 / min(0.999, max(1e-3, max(0.0, between - within) / max(1e-9, total - within))) - 1

    inside = lambda p: min(0.999, max(0.001, p))
    hosts, paths = sums(lambda x: x[1]), sums(lambda x: (x[1], x[2]))
    base = inside(sum(known) / len(known))
    mh = worth(hosts, lambda s: base)
    mp = worth(paths, lambda s: inside((hosts[s[0]][0] + mh * base) / (hosts[s[0]][1] + mh)))
    want = {}
    for (i, h, p, llr, _), e in zip(rows, known, strict=True):
        host = (hosts[h][0] - e + mh * base) / (hosts[h][1] - 1 + mh)
        path = (paths[h, p][0] - e + mp * host) / (paths[h, p][1] - 1 + mp)
        want[i] = (host, path, 1 / (1 + math.exp(-(llr + math.log(inside(path) / (1 - inside(path)))))))
    for most in (10_000, 5):  # few sites, and many with hot ones
        table = spark.createDataFrame(rows, "_id long, _host string, _path string, _llr double, _y int")
        got = {x._id: (x.host_rate, x.path_rate, x.posterior) for x in site_posteriors(table, prior, most).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_quality_stage_with_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "### !!! ") * 30, "s", "en", True, "x") for i in range(60)] + [(None, None, None, None, None, None)], "doc_id long, text string, source string, lang string, _good boolean, _id string")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} - {None} == {i for i in range(60) if i % 2}


def test_scores_with_many_ids_and_far_logits():
    r = np.random.default_rng(2)
    x = r.normal(size=(5, 8)).astype(np.float32) + np.array([0, -90, 30, -200, 5], np.float32)[:, None]
    at = np.array([1, 2, 3, 4, 5])
    want = (x - x.max(1, keepdims=True)) - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True))
    assert np.allclose(Network._log_share(x.copy(), at), want[np.arange(5), at], atol=1e-5)
    ids = 70_016
    net = Network(ids=ids)
    near = r.integers(0, ids + 1, (64, 4))
    near[0] = [3, 3 + 65_536, 3, 3 + 65_536]  # equal in 16 bits
    before = net.w["embed"].copy()
    Trainer(net).step(near, r.integers(1, ids + 1, 64))
    touched = np.flatnonzero((net.w["embed"] != before).any(1))
    assert set(touched) <= set(near.ravel()) and {3, 3 + 65_536} <= set(touched)


def test_quality_parts(spark):
    x = np.random.default_rng(0).normal(size=(200, 5)).astype(np.float32)
    m = fit(x, (x[:, 0] > 0).astype(float))
    assert ((m.log_ratio(x) > 0) == (x[:, 0] > 0)).mean() > 0.95
    df = spark.createDataFrame([("https://u@h.org:80/en/x?y",), ("src7",), (None,)], "s string")
    h, p = site_columns(F.col("s"))
    assert [tuple(r) for r in df.select(h, p).collect()] == [("h.org", "en"), ("src7", ""), ("", "")]


def test_lm_prefers_text_like_its_corpus(frame):
    rows = [(i, prose(i % 5, 400)) for i in range(40)] + [(100, " ".join(reversed(prose(1, 400).split()))), (101, None), (102, ""), (103, "word")]
    docs = frame(rows)
    vocabulary, net = train(docs)
    got = {r.doc_id: r for r in score(docs, vocabulary, net).collect()}
    assert len(got) == len(rows)
    assert got[101].n_words == got[102].n_words == 0 and got[101].mean_log_prob is None and got[102].log_likelihood == 0
    assert got[103].n_words == 1 and got[103].log_likelihood < 0
    assert train(frame([]))[1].flat().shape == Network().flat().shape
    assert score(frame([]), vocabulary, net).count() == 0


def test_lm_training_lowers_the_loss_and_probabilities_sum_to_one():
    text = prose(2, 3000)
    v = Vocabulary(sorted(set(words_of(text))))
    ids, _, lens = v.ids([text, "", "a"])
    laid, at = windows(ids, lens)
    near, y = laid[at[:, None] + OFFSETS], laid[at]
    assert lens.tolist()[1] == 0 and near[0][0] == 0
    net = Network()
    before = net.log_probs(near, y).mean()
    t = Trainer(net)
    for _ in range(30):
        t.step(near, y)
    assert net.log_probs(near, y).mean() > before + 1
    every = np.arange(1, 4097, dtype=np.int32)
    assert abs(np.exp(net.log_probs(np.repeat(near[5:6], 4096, 0), every).astype(float)).sum() - 1) < 1e-3


def test_lm_gradients():
    rng = np.random.default_rng(3)
    near, y = rng.integers(1, 50, (20, len(OFFSETS))).astype(np.int32), rng.integers(1, 200, 20).astype(np.int32)
    net = Network()
    t = Trainer(net, rate=1.0)
    grads = {}
    t._update = lambda name, g, rows=slice(None): grads.setdefault(name, []).append((rows, g.copy()))
    t.step(near, y)
    for name, at in (("bias", (3,)), ("class_w", (2, 1))):
        w = net.w[name]
        old, eps = w[at], 1e-2
        w[at] = old + eps
        up = -net.log_probs(near, y).astype(float).mean()
        w[at] = old - eps
        down = -net.log_probs(near, y).astype(float).mean()
        w[at] = old
        assert abs((up - down) / (2 * eps) - grads[name][0][1][at]) < 1e-3


def test_html_on_held_out_pages():
    m = trained()
    test = training_pages(60, seed=1234)
    pages = [Page(s) for s, _ in test]
    kept = decode(pages, m.trees.log_odds(features(pages, m.weight)))
    assert (kept == np.concatenate([y for _, y in test])).mean() > 0.98


def test_html_decoding_is_consistent_and_best():
    rng = np.random.default_rng(5)
    p = Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><div>d</div>")
    n = len(p.parent)
    for _ in range(30):
        s = rng.normal(0, 2, n)
        got = decode([p], s)
        assert got[0] and all(got[p.parent[i]] for i in range(1, n) if got[i])
        best = -1e9
        for mask in range(1 << (n - 1)):
            k = [True] + [bool(mask >> i & 1) for i in range(n - 1)]
            if all(k[p.parent[i]] for i in range(1, n) if k[i]):
                best = max(best, sum(x if y else -x for x, y in zip(np.clip(s, -4, 4)[1:], k[1:], strict=True)))
        assert abs(sum(x if y else -x for x, y in zip(np.clip(s, -4, 4)[1:], got[1:], strict=True)) - best) < 1e-9


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class='ad'>Buy now</div>"
    "<article><h1>Title here</h1><p>First &amp; longer   paragraph of the story,<br>with a break.<p>Second &#233; <b>bold<p>Third one is long enough too.</article>"
    "<section class='comments'><h3>Comments</h3><div class='comment'><p>I liked this a lot, thank you.</p></div></section><footer>&copy; someone</footer><script>var x='<p>no</p>'</script></body></html>"
)


def test_html_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "plain &lt;text&gt;"), (5, "u", "<div" * 500), (6, "u", "<p>" * 3000 + "deep"), (1, "u", PAGE), (7, "u", "<p>x" + "y" * 300_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == "Title here\n\nFirst & longer paragraph of the story, with a break.\n\nSecond é bold\n\nThird one is long enough too."
    assert by[2].text == by[3].text == "" and by[4].text == "plain <text>" and all(r.n_chars == len(r.text) for r in got)
    assert extract(df.limit(0)).count() == 0


FIRST = "The council met on Tuesday to discuss the plan, which had been delayed twice. Members of the public spoke for an hour."
SECOND = "Afterwards, the mayor said that work would begin in spring, and that costs had been kept low."
REMARK = "I totally disagree with this, they never listen to us. Great article though, thanks for sharing it with all of us!"
STORY = f"<article><h1>Council meets</h1><p>{FIRST}</p><p>{SECOND}</p></article>"
AROUND = {
    "comments after": f"{STORY}<section class='comments'><h2>Comments</h2><div class='comment'><p>{REMARK}</p></div></section>",
    "comments inside": f"{STORY[:-10]}<div class='comments'><p>{REMARK}</p></div></article>",
    "comments that are articles": f"{STORY}<section id='comments'><article><p>{REMARK}</p></article></section>",
    "sidebar": f"<div class='sidebar'><h3>Popular</h3><ul><li><a href='x'>One story</a></li></ul></div>{STORY}<aside><p>{REMARK}</p></aside>",
    "notice": f"<div class='cookie-notice'><p>We use cookies on this site. <button>OK</button></p></div><div class='notice'>We are moving.</div>{STORY}",
    "form": f"{STORY}<form action='/s'><p>Subscribe to our newsletter</p><input><button>Go</button></form>",
    "header": f"<header><h1>Example Daily</h1><p>News since 1900</p></header>{STORY}",
    "no semantic tags": f"<div id='header'>Example Daily</div><div id='content'>{STORY[9:-10]}</div><div id='footer'>&copy; 2024 Example</div>",
    "advert inside": STORY.replace("</p><p>", "</p><div class='ad'>Buy cheap pills now, limited offer!</div><p>"),
    "unclosed": f"<article><h1>Council meets</h1><p><b>{FIRST}<br><p>{SECOND}</article>",
}


@pytest.mark.parametrize("name", AROUND)
def test_html_leaves_out_what_stands_around(name):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>{AROUND[name]}<footer>&copy; example.com</footer></body></html>"
    assert trained().extract([page]) == [f"Council meets\n\n{FIRST}\n\n{SECOND}"]


def test_lm_masks_a_share_of_every_document_in_every_round():
    keys, lens = np.arange(-200, 200) * 7919, np.arange(400) % 90
    first = np.cumsum(lens) - lens
    for k in range(3):
        at = masked(keys, lens, k)
        assert len(set(at.tolist())) == len(at) == (-(-lens // MASKED)).sum()
        own = np.bincount(np.searchsorted(first + lens, at, side="right"), minlength=400)
        assert (own == -(-lens // MASKED)).all()
        places = np.bincount(at % MASKED, minlength=MASKED) / len(at)
        assert abs(places - 1 / MASKED).max() < 0.03
        assert set(at.tolist()) != set(masked(keys, lens, k + 1).tolist())


def test_lm_every_round_trains(frame):
    docs = frame([(i, prose(i, 120)) for i in range(40)])
    for k in (0, 1):
        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == k)
        assert own.count() and (train(own)[1].flat() != Network().flat()).any()


def test_lm_training_masks_every_word_once(frame, monkeypatch):
    seen, averaged = [], lm_scoring._averaged

    def watched(parts, size):
        out = averaged(parts, size)
        seen.append(out[1])
        return out

    monkeypatch.setattr(lm_scoring, "_averaged", watched)
    texts = [*(prose(i, 10 + 37 * i) for i in range(40)), None, "", "one", ". , .", "far " * 9000]
    train(frame(list(enumerate(texts))))
    assert len(seen) == 2 and min(seen) and sum(seen) == sum(len(words_of(t or "")) for t in texts)


def test_lm_runs_equal_windows_of_single_words():
    r = np.random.default_rng(4)
    lens = np.array([0, 1, 2, 700, 0, 3, 300, 1])
    ids = r.integers(1, 200, lens.sum()).astype(np.uint16)
    laid, at = windows(ids, lens)
    near, y = laid[at[:, None] + OFFSETS], laid[at]
    cuts = list(lm_scoring.runs(laid, at, 256))
    assert np.concatenate([run[own + lm_scoring.SIDE] for run, own in cuts]).tolist() == ids.tolist()
    nets = [Network(), Network()]
    trainers = [Trainer(n) for n in nets]
    for i, (run, own) in enumerate(cuts):
        here = slice(256 * i, 256 * i + 256)
        assert np.allclose(nets[0].log_probs_in(run, own), nets[0].log_probs(near[here], y[here]), atol=1e-4)
        trainers[0].step_in(run, own)
        trainers[1].step(near[here], y[here])
    assert trainers[0].seen == trainers[1].seen == len(ids)
    assert all(np.allclose(nets[0].w[k], nets[1].w[k], atol=1e-3) for k in nets[0].w)


def test_lm_scores_marks(frame):
    texts = ['Well, "so-called" words (and_marks) ... l\'été\u3000x=1!', ". , .", "", "a\x1cb\xa0c"]
    v = Vocabulary(["well", "so", ".", ",", "x"])
    for _ in range(2):
        ids, _, lens = v.ids(texts)
        assert lens.tolist() == [len(words_of(t)) for t in texts] and lens[1] == 3
        assert ids.tolist() == [v._id(w) for t in texts for w in words_of(t)]
    docs = frame([(i, t) for i, t in enumerate([*texts, *(prose(i, 60) for i in range(20))])])
    n: dict[str, int] = {}
    for r in docs.collect():
        for w in words_of(r.text):
            n[w] = n.get(w, 0) + 1
    assert {r.word: r.n for r in word_counts(docs, "text").collect()} == n
    vocabulary, net = train(docs, words=128)
    assert len(vocabulary.frequent) == 128 or len(n) < 128
    got = {r.doc_id: r for r in score(docs, vocabulary, net).collect()}
    for r in docs.collect():  # word by word
        words = words_of(r.text)
        ids = [0, 0, *map(vocabulary._id, words), 0, 0]
        want = 0.0
        for i, w in enumerate(words):
            h = np.tanh(net.w["bias"] + sum(net.w["embed"][ids[i + 2 + o]] * net.w["place"][j] for j, o in enumerate((-2, -1, 1, 2))))
            c, k = divmod(ids[i + 2] - 1, 64)
            for x, at in ((h @ net.w["class_w"] + net.w["class_b"], c), (h @ net.w["word_w"][c] + net.w["word_b"][c], k)):
                want += float(x[at] - np.log(np.exp(x.astype(float)).sum()))
            if ids[i + 2] > vocabulary.most:
                raw = [256, *w.encode(), 256]
                want += min(0.0, float(sum(vocabulary.spelling[a, b] for a, b in zip(raw, raw[1:]))) + float(np.log(256)))
        assert abs(got[r.doc_id].log_likelihood - want) < 1e-3 * max(1, len(words)) and got[r.doc_id].n_words == len(words)
    assert score(frame([(1, "word, " * 40_000)]), vocabulary, net).first().n_words == 80_000
    assert got[1].n_words == 3 and got[1].log_likelihood < 0 and got[1].mean_log_prob < 0
