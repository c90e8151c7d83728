"""Byte BPE, quality rules, main text, language ID and language-model scores against plain Python."""

import hashlib
import html
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, found, none_of, prose  # noqa: E402

from millrace.llm import boosting, byte_bpe, language, main_text, quality, suffix_lm  # noqa: E402
from millrace.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# ---- byte BPE


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_segments_do_not_change_ids(size):
    encoder = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in ["", "a", "don't we'll  x\n\n y", "abc123's" * 20, "    \n x" * 9, "日本語 text 😀" * 5, prose(3), "x" * 5000, "'''s 's"]:
        assert "".join(byte_bpe.segments(text, size)) == text
        assert byte_bpe.encode(encoder, text, size) == encoder.encode_ordinary(text)


def test_byte_bpe_digests(spark):
    encoder: tiktoken.Encoding = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    source = documents(spark, "n_tokens ids")
    expected = []
    for r in source.collect():
        ids, raw = encoder.encode_ordinary(r.text or ""), (r.text or "").encode()
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert found(byte_bpe.round_trip_digests(source, RANKS, public_tokenizers.PATTERN)) == sorted(expected, key=repr)
    assert found(byte_bpe.round_trip_digests(none_of(spark), RANKS, public_tokenizers.PATTERN)) == []


def test_byte_bpe_round_trip(spark):
    source = documents(spark)
    back = byte_bpe.detokenize(byte_bpe.tokenize(source, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in source.collect())


# ---- quality rules


def base_of(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    model = boosting.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), quality.MONOTONE)
    for source in (documents(spark, "kept n_words"), spark.read.parquet(f"{SF}/documents.parquet")):
        expected = sorted(((r.doc_id, *base_of(r.text or "")) for r in source.collect()), key=repr)
        scored = quality.score_documents(source, model)
        assert found(scored.select("doc_id", *quality.BASE)) == expected
        for r in scored.collect():
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed)  # without labels the trees say yes to all
    assert found(quality.score_documents(none_of(spark), model)) == []


def test_quality_verdicts_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    judged = quality.score_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert len(judged) > 80 and sum(r.kept == (r.quality == 1) for r in judged) >= 0.98 * len(judged)


def test_quality_without_labels_and_filter_keeps_columns(spark):
    source = documents(spark, "kept quality_score")
    labels = spark.createDataFrame([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(source, labels)
    kept = quality.keep_good(source, model)
    assert kept.columns == source.columns and {r.kept for r in kept.collect()} == {"clash"}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(r.doc_id for r in quality.score_documents(source, model).where("kept and doc_id is not null").collect())
    assert quality.keep_good(none_of(spark), model).collect() == []


def test_trees_follow_monotone_constraints():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] + 0.3 * rng.normal(size=800) > 0) ^ (np.abs(x[:, 1]) > 1.5)).astype(float)
    trees = boosting.fit(x, y, np.array([1, 0, -1]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9
    probe = rng.normal(size=(100, 3))
    for feature, sign in ((0, 1), (2, -1)):
        grid = np.repeat(probe[:, None], 41, axis=1)
        grid[:, :, feature] = np.linspace(-3, 3, 41)
        margin = trees.margin(grid.reshape(-1, 3)).reshape(100, 41)
        assert (sign * np.diff(margin, axis=1) >= -1e-12).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    trees = boosting.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), np.zeros(2, int), trees=7)
    for row in x[:40]:
        total = trees.bias
        for t in range(7):
            at = 0
            while at < trees.feature.shape[1]:
                at = 2 * at + 1 + int(row[trees.feature[t, at]] > trees.threshold[t, at])
            total += trees.leaf[t, at - trees.feature.shape[1]]
        assert trees.margin(row[None])[0] == pytest.approx(total)


# ---- main text


def test_main_text_of_given_pages(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def article(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"<[^>]+>", "", re.sub("<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inside)]
        return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)

    got = {r.page_id: r for r in main_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        assert got[i].text == article(page) and got[i].n_chars == len(got[i].text)


LONG = "This is the story of a man who had to go to the town and it was not easy for him to do so. " * 4


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>a &lt; b &amp;&nbsp;c</p>", "a < b & c"),
        (f"<div class='cookie-notice'>{LONG}</div><article><header><h1>Title</h1></header><p>{LONG}</p><p>Short.</p><div class=comments><p>{LONG}</p></div></article>", f"Title\n{LONG.strip()}\nShort."),
        (f"<header>Site</header><div><p>{LONG}</p><p>Short end.</p></div><div><a href=x>one</a> <a href=y>two</a></div><p>tail</p><footer>{LONG}</footer>", f"{LONG.strip()}\nShort end."),
        (f"<main><p>{LONG}<form>name <input></form><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style><!-- <p>no</p> --><p>end", f"{LONG.strip()}\nend"),
        (f"<article><p>{LONG}</p><aside>side</aside><ul><li><a href=a>link one</a></li><li><a href=b>link two</a></li></ul><p>last\n words</p></article>", f"{LONG.strip()}\nlast words"),
        ("<p title='a > b'>quoted", "quoted"),
        ("<p 'unclosed " + "<p>x " * 3, "x\nx\nx"),
        (f"<p>{'Zzz qqq xxx ' * 20}</p><p>{LONG}</p>", LONG.strip()),
    ],
)
def test_main_text_rules(page, expected):
    assert main_text.main_text(page) == expected


def test_main_text_short_blocks_follow_neighbours():
    labels = ["short", "good", "short", "short", "bad", "short", "near", "good"]
    assert main_text.second_pass(labels, [0] * 8) == [True, True, True, False, False, False, True, True]
    assert main_text.second_pass(["short", "near"], [0, 0]) == [True, True]
    assert main_text.second_pass(["short", "bad"], [1, 0]) == [True, False]


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article><div class=sidebar>{LONG}</div></div>", LONG.strip()),
        (f"<div id='page' class='single comments-open'><article><p>{LONG}</p></article><div id=comments><article class=comment>{LONG}</article></div></div>", LONG.strip()),
        (f"<div class='content no-share'><p>{LONG}</p></div><footer>{LONG}</footer>", LONG.strip()),
        (f"<form action=x><div class=widget><p>{LONG}</p><p>{LONG}</p><div class=comments>{LONG}</div></div></form>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<div class=social><main><p>{LONG}</p><form>{LONG}</form></main></div>", LONG.strip()),
        (f"<header><main><p>{LONG}</p></main></header>", LONG.strip()),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div id=comments><article class=comment><p>{LONG}</p></article></div>", f"{LONG.strip()}\n{LONG.strip()}"),
        (f"<article><div class='share-page'><p>{LONG}</p></div></article>", LONG.strip()),
    ],
)
def test_main_text_wrappers_named_like_furniture(page, expected):
    assert main_text.main_text(page) == expected


ITALIAN = "Durante quegli anni molti contadini lasciarono i campi della pianura per cercare lavoro nelle fabbriche di Torino, dove trovarono nuove abitudini."
RUSSIAN = "Зимой мы часто ходили через замёрзшее озеро в соседнюю деревню, где жила моя бабушка, и возвращались только поздно вечером."
CHINESE = "那年冬天我们常常走过结冰的湖面去邻村看望祖母，直到天黑以后才慢慢回到家里，路上只有风声和雪。"
GERMAN = "Messwerte Januar bis Dezember: Hamburg 14,2 Grad, München 12,9 Grad, Dresden 13,1 Grad, Leipzig 13,4 Grad, Rostock 12,2 Grad sowie Kassel 11,8 Grad im Mittel."
TABLE = "Hamburg 14,2 München 12,9 Dresden 13,1 Leipzig 13,4 Rostock 12,2 Kassel 11,8 Bremen 12,4 Erfurt 11,9 " * 3
MENU = "<div><a href=x>one link</a> <a href=y>another link</a></div>"


@pytest.mark.parametrize("text", [ITALIAN, RUSSIAN, CHINESE, GERMAN])
def test_main_text_of_other_languages_and_of_content_words(text):
    assert main_text.main_text(f"{MENU}<h1>Short</h1><div><p>{text}</p><p>{text * 3}</p><p>ab</p></div>{MENU}").split("\n")[-3:] == [text, text * 3, "ab"]
    assert main_text.main_text(f"<div><p>{LONG}</p><p>{text}</p><p>{LONG}</p></div>") == f"{LONG.strip()}\n{text}\n{LONG.strip()}"


def test_main_text_keeps_tables_and_text_between_links():
    assert main_text.main_text(f"<p>{LONG}</p><table><tr><td>{TABLE}</td></tr></table>") == f"{LONG.strip()}\n{TABLE.strip()}"
    assert main_text.main_text(f"<p>{LONG}</p>{MENU}<p>{GERMAN}</p>{MENU}") == f"{LONG.strip()}\n{GERMAN}"
    assert main_text.main_text(f"{MENU}<p>{ITALIAN}</p><footer>{LONG}</footer>") == ITALIAN


def test_main_text_awkward_rows(spark):
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", "<div>" * 20_000 + "deep")]
    source = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as n_chars")
    assert found(main_text.extract(source)) == sorted([(1, "u", "", 0), (None, None, "x", 1), (2, "u", "x", 1), (2, "u", "x", 1), (3, "u", "deep", 4)], key=repr)
    assert found(main_text.extract(none_of(spark, "page_id long, url string, html string"))) == []


# ---- language ID


def test_language_on_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_awkward_rows(spark):
    source = documents(spark, "lang_pred score")
    net = language.fit(source, steps=30)
    assert set(net.labels) <= {"en", "de", "fr", "es"} and net.labels
    rows = language.identify(source, net).collect()
    assert len(rows) == source.count()
    for r in rows:
        if r.doc_id in (3, 4, 5, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in net.labels
    nothing = language.fit(none_of(spark))
    assert nothing.labels == [] and {r.lang_pred for r in language.identify(source, nothing).collect()} == {"und"}
    assert language.keep_identified(source, nothing).columns == source.columns
    assert language.identify(none_of(spark), net).collect() == []


def test_network_gradients():
    rng = np.random.default_rng(0)
    windows, y = rng.integers(0, 256, (6, 24), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = language.train(windows, y, ["a", "b", "c"], steps=1)
    for p in (net.embedding, net.weights, net.offset, *net.filters, *net.biases):
        p[...] = rng.normal(0, 0.5, p.shape)
    grads = language._gradients(net, windows, y)
    loss = lambda: -net.log_probabilities(windows)[np.arange(6), y].mean()
    for p, g in zip([net.embedding, *net.filters, *net.biases, net.weights, net.offset], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = p[at]
        p[at] = before + 1e-2
        up = loss()
        p[at] = before - 1e-2
        assert g[at] == pytest.approx((up - loss()) / 2e-2, rel=0.15)
        p[at] = before


# ---- language-model scores


def lm_of(docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t in docs]
    counts = Counter(w for i, words in split if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(i, held[i], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, w in split]


@pytest.mark.parametrize("source", ["awkward", "given"])
def test_word_counts_and_base_scores(spark, source, monkeypatch):
    monkeypatch.setattr(suffix_lm, "FREQUENT_SHARE", 0.01)  # so that most words take the join
    frame = documents(spark, "score n") if source == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    expected = sorted(lm_of([(r.doc_id, r.text) for r in frame.collect()]), key=repr)
    got = found(suffix_lm.score_documents(frame).drop("score"))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])


def test_suffix_tree_scores_are_probabilities_of_longest_suffixes():
    texts = [suffix_lm.words_of((prose(i) + " abracadabra").encode()) for i in range(300)]
    runs = Counter()
    for words in texts:
        text = suffix_lm.symbols(words)
        for i in range(suffix_lm.DEPTH, len(text)):
            for d in range(suffix_lm.DEPTH + 1):
                runs[d, text[i - d : i], text[i]] += 1
    total = sum(n for (d, _, _), n in runs.items() if d == 0)
    contexts = {}
    for (d, context, byte), n in runs.items():
        contexts.setdefault((d, int.from_bytes(context, "big")), []).append((byte, n))
    kept = sorted((d, c, sum(n for _, n in following), sorted(following)) for (d, c), following in contexts.items() if sum(n for _, n in following) >= max(2, math.ceil(suffix_lm.MIN_SHARE * total)))
    tree = suffix_lm._tree(kept)
    assert len(tree.depths) > 50 and tree.depths.max() == suffix_lm.DEPTH
    spread = np.exp(tree.logp.astype(float))
    classes = tree.logp.shape[1]
    spread[:, -1] *= 256 - (classes - 1)
    assert np.allclose(spread.sum(axis=1), 1, atol=1e-4)
    states = {(int(d), int(c)): i for i, (d, c) in enumerate(zip(tree.depths, tree.codes))}

    def plain(words):
        text, score = suffix_lm.symbols(words), 0.0
        for i in range(suffix_lm.DEPTH, len(text)):
            for d in range(suffix_lm.DEPTH, -1, -1):
                code = 0
                for b in text[i - d : i]:
                    code = code * classes + int(tree.class_of[b])
                if (d, code) in states:
                    score += float(tree.logp[states[d, code], tree.class_of[text[i]]])
                    break
        return score

    probes = [texts[0], texts[7], [], [b"qqq", "日本".encode()], [b"x" * 3000]]
    assert suffix_lm._in_parts(tree.ready(), probes) == pytest.approx([plain(w) for w in probes], rel=1e-5)


def test_suffix_tree_beats_its_root_on_held_out_documents(spark):
    rows = QUERIES["op8_suffix_tree"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.score < 0 for r in rows)
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -4.5
    empty = suffix_lm.score_documents(none_of(spark))
    assert empty.collect() == []


def test_contexts_of_a_rare_script_are_learned():
    """A few Cyrillic texts among many others: their bytes have classes of their own and contexts of their own."""
    texts = [suffix_lm.words_of(prose(i).encode()) for i in range(200)]
    texts += [suffix_lm.words_of("съешь ещё этих мягких французских булок да выпей чаю".encode() * 3) for _ in range(8)]
    runs = Counter()
    for words in texts:
        text = suffix_lm.symbols(words)
        for i in range(suffix_lm.DEPTH, len(text)):
            for d in range(suffix_lm.DEPTH + 1):
                runs[d, text[i - d : i], text[i]] += 1
    contexts = {}
    for (d, context, byte), n in runs.items():
        contexts.setdefault((d, int.from_bytes(context, "big")), []).append((byte, n))
    tree = suffix_lm._tree(sorted((d, c, sum(n for _, n in following), sorted(following)) for (d, c), following in contexts.items() if sum(n for _, n in following) > 5))
    lookup = tree.ready()
    known, other = (suffix_lm._in_parts(lookup, [suffix_lm.words_of(w.encode())])[0] for w in ("французских", "ффранцухксиз"))
    assert len(set(tree.class_of.tolist())) > 50 and known > other / 3


HOT = "doc_id long, text string, lang string"


def test_samples_of_one_hot_id_stay_small(spark, monkeypatch):
    """A third of all rows under one id: the driver gets one row of it, and every language is learned."""
    rows = [(7, prose(1), "en")] * 4000 + [(i, prose(i), ("en", "de", "fr")[i % 3]) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, HOT).repartition(8)
    seen = []
    real = language.train
    monkeypatch.setattr(language, "train", lambda x, y, labels, steps: seen.append((len(x), labels)) or real(x, y, labels, steps=5))
    net = language.fit(docs, docs_per_label=40)
    assert net.labels == ["de", "en", "fr"] and seen[0][0] <= 40 * 3 * 8
    only = spark.createDataFrame([(7, prose(1), "en")] * 4000, HOT)
    assert language.fit(only).labels == (["en"] if __import__("zlib").crc32(b"7") % 4 != 2 else [])
    labels = spark.createDataFrame([(7, 1), *[(i, i % 2) for i in range(100, 400)]], "doc_id long, quality int")
    sizes = []
    fit = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda x, y, m: sizes.append(len(x)) or fit(x, y, m))
    quality.fit(docs, labels)
    assert sizes == [301]


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t", "\u3000 "])
def test_long_white_space(blank):
    import public_tokenizers
    import regex

    encoder = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    run = blank * (2_000_000 // len(blank))
    for text in (run, "word" + run, run + "word", f"a b{run}c d{run}x"):
        ids = byte_bpe.encode(encoder, text)
        assert byte_bpe.decode(encoder, ids) == text.encode()
    for size in (byte_bpe.LONG_RUN, byte_bpe.LONG_RUN + 5):  # what the library itself can take
        for text in (f"a{blank * size}b c", f"a{blank * size}", f"{blank * size}!"):
            assert byte_bpe.encode(encoder, text) == encoder.encode_ordinary(text)
    assert byte_bpe.whole_runs(public_tokenizers.PATTERN) and not byte_bpe.whole_runs(r"\s|\S+")


@pytest.mark.parametrize("page", ["<a " * 330_000, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 200_000, "<p" * 500_000 + "text", "<!-- " * 200_000, "<script>" * 100_000, "</div>" * 150_000 + "end"])
def test_broken_markup_takes_linear_time(page):
    import time

    begin = time.process_time()
    main_text.blocks(page)
    assert time.process_time() - begin < 4


def test_comments_and_scripts_without_end():
    assert main_text.main_text("<p>one</p><!-- two <p>three</p> four") == "one"
    assert main_text.main_text("<p>one</p><script>two <p>three</p> four") == "one"
    assert main_text.main_text("<p>one</p> two <!-- three") == "one\ntwo"
    assert main_text.main_text("<p>one</p> two < three <four") == "one\ntwo < three <four"


def test_long_text_without_stop_words_stays():
    prose_block = "<p>" + "This is the story of a man who had to go to the town and it was not easy for him to do so. " * 6 + "</p>"
    names = "Karajan Furtwangler Celibidache Toscanini Bernstein Abbado Kleiber Szell Solti Barbirolli " * 5
    assert names.strip() in main_text.main_text(f"<div>{prose_block}<p>{names}</p>{prose_block}</div>")
