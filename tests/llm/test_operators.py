"""The operators against brute force, round trips and held-out accuracy, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken.load import load_tiktoken_bpe
from tokenizers import Tokenizer

from millrace.llm import audio, bpe, decontam, forest, html, lm, queries, records, sharding, substring, toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("id", T.IntegerType())])
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ner", "tu") for b in ("ra", "sel", "vo", "ti", "gan") for c in ("", "n", "s", "do", "bel")]


def some(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Texts with nulls, repeats, a very long one, near copies and strange characters."""
    rng = random.Random(5)
    base = [some(rng, 120) for _ in range(12)]
    near = base[0].split()
    near[60] = "changed"
    texts = [None, "", " \t\n ", "one", "One two THREE", *base, base[0], base[0].upper(), " ".join(near), some(rng, 30_000), "a" * 20_000, "naïve Ünïcode 東京\x1c x   é é 🙂", "\x00\x85 mixed\x0bspace"]
    texts += [base[3]] * 30
    rows = [(k, t, None if k % 3 else "en", "s", None, "k", k % 2) for k, t in enumerate(texts)]
    return rows + [rows[5], (None, base[1], None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def table(spark, odd):
    return spark.createDataFrame(odd, DOCS).repartition(5)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_audio(table, odd):
    got = audio.audio_digests(table).collect()
    assert len(got) == len(odd)
    by = defaultdict(set)
    for r in odd:
        raw = (r[1] or "").encode()
        by[r[0]].add(hashlib.sha256(raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))).hexdigest())
    features = {}
    for r in got:
        assert r.payload_sha256 in by[r.doc_id] and r.payload_bytes % 64 == 0 and r.payload_bytes >= max(r.n_bytes, 64)
        assert features.setdefault(r.payload_sha256 + str(r.n_bytes), (r.feature, r.media_sha256, r.tail_crc32)) == (r.feature, r.media_sha256, r.tail_crc32)
    tensors = audio.audio_tensors(table.filter("length(text) < 2000")).toArrow()
    shaped = audio.as_tensors(tensors.column("tensor").combine_chunks())
    assert shaped.type.shape == [audio.FRAMES, audio.MELS] and len(shaped) == tensors.num_rows


def test_resampling_is_a_low_pass():
    t = np.arange(16_000) / audio.RATE
    low, high = (np.sin(2 * np.pi * f * t).astype(np.float32) for f in (500, 7500))
    sound = audio.resample(low)
    assert len(sound) == len(t) * audio.UP // audio.DOWN
    assert np.abs(sound[200:-200]).max() > 0.9 and np.abs(audio.resample(high)[200:-200]).max() < 0.1
    at = np.arange(len(sound)) * audio.DOWN / audio.UP / audio.RATE  # the tone keeps its pitch, but for a delay
    assert min(np.abs(sound - np.sin(2 * np.pi * 500 * (at - d / audio.RATE)))[200:-200].max() for d in np.arange(-1, 1, 0.05)) < 0.02


def test_audio_features_by_loops():
    rng = np.random.default_rng(6)
    raw = rng.integers(0, 256, 3000).astype(np.uint8)
    samples = raw.astype(np.float64) / 128 - 1
    taps, up, down = audio.TAPS, audio.UP, audio.DOWN
    t = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(taps * up)
    slow = []
    for k in range(-(-len(samples) * up // down)):
        at, phase = divmod(k * down, up)
        own = [h[(taps - 1 - j) * up + phase] for j in range(taps)]
        slow.append(sum(w * samples[i] for j, w in enumerate(own) if 0 <= (i := at + j - taps // 2) < len(samples)) / sum(own))
    sound = audio.resample(samples.astype(np.float32))
    assert np.allclose(sound, slow, atol=1e-4)
    mels, energy = audio.log_mel(sound)
    window, bank = audio._tables()[1:]
    for k in (0, 5, len(mels) - 1):
        frame = np.zeros(audio.FRAME)
        part = sound[k * audio.HOP : k * audio.HOP + audio.FRAME]
        frame[: len(part)] = part
        power = np.abs(np.fft.fft(np.append(frame * window, np.zeros(audio.FFT - audio.FRAME)))[: audio.FFT // 2 + 1]) ** 2
        assert np.allclose(mels[k], [math.log(sum(p * w for p, w in zip(power, bank[:, j])) + 1e-6) for j in range(audio.MELS)], atol=1e-2)
    low, high = np.quantile(energy, [audio.QUIET, audio.LOUD])
    want, start, loud = [], None, False
    for k, e in enumerate([*energy, -np.inf]):
        if e >= low:
            start, loud = k if start is None else start, loud or e >= high
        elif start is not None:
            want += [(start, k)] if loud else []
            start, loud = None, False
    assert audio.segments(energy) == want
    sounds = [audio.media_of(x) for x in ("", "some words " * 900, None)]
    for m, (tensors, spans) in zip(sounds, audio.stored_tensors(audio.stored_bytes(audio.store(sounds)), 3)):
        assert np.array_equal(tensors, m.tensors) and spans.tolist() == [list(s) for s in m.spans]


def test_language_scores(spark, table, odd, sf_dir):
    got = lm.language_scores(table).collect()
    train = [r for r in odd if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in words(r[1]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = Counter()
    for d, t, *_ in odd:
        ws = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        want[d, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = lm.language_scores(read(spark, sf_dir, "documents")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]  # better than the unigram model on texts it has not seen


def test_lm_symbol_probabilities_are_normalised():
    cells, counts = np.arange(0, 3000, 7), np.ones(429)
    logs = lm.train(cells, counts, steps=20).reshape(-1, lm.SYMBOLS)
    assert np.allclose((10.0**logs).sum(axis=1), 1, atol=1e-3)


def test_lm_learns_from_every_cell():
    """A cell of one triple in ten million moves the model, and the seed of a draw does not decide whether."""
    cells, counts = np.arange(0, 3000, 7), np.full(429, 1e5)
    extra = np.array([100 * lm.SYMBOLS**2 + 100 * lm.SYMBOLS + 100])
    plain = lm.train(cells, counts).reshape(-1)
    for seed in (7, 8):
        more = lm.train(np.concatenate([cells, extra]), np.concatenate([counts, [4.0]]), seed=seed).reshape(-1)
        assert more[extra[0]] > plain[extra[0]] + 1


def test_html_on_unseen_pages(spark):
    rng = np.random.default_rng(99)
    pages, want = [], []
    while len(pages) < 40:
        page, labels = html.made_page(rng)
        found = html.blocks(page)
        if found and len(found) == len(labels):
            pages.append(page)
            want.append("\n\n".join(b.text for b, y in zip(found, labels) if y))
    hard = ["<nav><a href=x>Home</a></nav><article><p>One &amp; two\n  three&#33;</p><p>Fourth sentence is here, with words.</p></article><script>var x = '<p>no</p>';</script>", None, "", "<p"]
    rows = [(k, "u", p, k) for k, p in enumerate(pages + hard)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    exact = sum(got[k].text == w for k, w in enumerate(want))
    assert exact >= 33  # some of them name nothing
    assert "One & two three!" in got[40].text and "Home" not in got[40].text and "var" not in got[40].text
    assert got[41].text == got[42].text == "" and all(r.n_chars == len(r.text) for r in got.values())


def test_html_on_pages_written_by_hand(spark):
    """Kinds of pages that the generator does not write: text to keep, and text to leave out."""
    one, two = "The first paragraph has several words and goes on for a while, as they do.", "The second one is here too, with more words in it and an end."
    pages = {
        f"<html><body><div><div><h1>A title of the page</h1><p>{one}</p><p>{two}</p></div></div></body></html>": (["A title of the page", one, two], []),
        f"<main><section><h1>A title here</h1><p>{one}</p><p>{two}</p></section><section class='comments'><p>Nice post, thanks.</p><p>I agree with it.</p></section></main>": (["A title here", one, two], ["Nice post", "I agree"]),
        f"<p>{one}</p><p>{two}</p>": ([one, two], []),
        "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav><article><h1>Formulas</h1><p>Some math <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <noscript>fallback words</noscript> go on with text until the end.</p></article><footer>Copyright 2020</footer>": (["Formulas", "Some math x=2 and fallback words go on with text until the end."], ["Home", "Copyright"]),
        f"<div class='css-1ab2'><ul class='css-9x'><li><a href=/>Home</a></li><li><a href=/b>News</a></li><li><a>Contact</a></li></ul></div><div class='css-77'><h1>Some long title</h1><p>{one}</p><p>{two}</p></div><div class='css-3'>Copyright 2021 All rights reserved</div>": (["Some long title", one, two], ["Home", "Copyright"]),
        f"<nav><a href=/>Home</a></nav><main><h1>Prices</h1><p>{one}</p><table><tr><th>Place</th><th>Price</th></tr><tr><td>Here</td><td>12</td></tr></table></main><aside class=sidebar><p>More stories you may like</p></aside>": (["Prices", one, "Place", "Price", "Here", "12"], ["Home", "More stories"]),
    }
    rows = [(k, "u", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")).collect()}
    for k, (keep, leave) in enumerate(pages.values()):
        assert got[k] == "\n\n".join(keep) and not any(x in got[k] for x in leave), got[k]


def test_html_long_attributes_and_deep_elements():
    for quote in "\"'":
        page = f"<p data-x={quote}{'a > b ' * 2000}{quote}>Text.</p><p>More.</p>"
        assert [b.text for b in html.blocks(page)] == ["Text.", "More."]
    deep = "<main>" + "<div>" * 700 + "<section>in</section>" + "</div>" * 700 + "<p>out</p></main><p>after</p>"
    paths = {b.text: b.path for b in html.blocks(deep)}
    assert paths["out"] == ("main", "p") and paths["after"] == ("p",) and len(paths["in"]) == 500


def test_byte_bpe_equals_tiktoken(spark, table, odd, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    made = bpe.Codec.load(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [r[1] or "" for r in odd] + [r.text or "" for r in read(spark, sf_dir, "documents").collect()]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(made.encode(t), "<u4").tolist()
        assert ids == peer.encode_ordinary(t)
        assert made.decode(np.array(ids, "<u4").tobytes()) == t.encode()
    coded = bpe.encode_column(table, path, public_tokenizers.PATTERN, decoded="back")
    assert coded.filter("NOT (decode(back, 'UTF-8') <=> coalesce(text, ''))").count() == 0 and coded.count() == len(odd)


def test_toxicity_on_held_out_rows(spark, table, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.judge(docs, labels).join(labels, "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert got and right >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    model = toxicity.fitted(docs, labels)
    spans = toxicity.toxic_spans(docs, model).limit(20).collect()
    assert spans and all(s.start < s.end for s in spans)
    assert toxicity.judge(table, labels.limit(0)).filter("score < 1e-12 AND predicted = 0").count() == len(odd)
    blank = toxicity.train([("", 1), ("12", 0)])
    assert np.allclose(blank.score(["some text", None]), 0.5)
    again = docs.union(docs)
    assert toxicity.drop_toxic(again, labels).columns == docs.columns


def test_marginals_and_gradients_equal_enumeration():
    rng = np.random.default_rng(4)
    crf = toxicity.Crf(["a", "b"], {"own": [0.3, -1.0, 2.0], "before": [0.0, 0.7, -0.4], "after": [0.0, -0.2, 0.9], "trans": [[0.5, -1.2], [0.1, 1.4]]})
    chains = [rng.normal(0, 3, n) for n in (1, 0, 7, 2, 1, 9, 0)]
    found = crf.marginals(chains)
    flat = np.concatenate(chains)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, 1, 7, 2, 1])] = True
    inner = np.flatnonzero(~first)
    expected = np.zeros((2, 2))
    for e, m in zip(chains, found):
        total, toxic, moves = 0.0, np.zeros(len(e)), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=len(e)):
            t = np.array(tags, int)
            weight = math.exp((e * t).sum() + sum(crf.trans[a, b] for a, b in zip(t, t[1:])))
            total += weight
            toxic += weight * t
            for a, b in zip(t, t[1:]):
                moves[a, b] += weight
        assert len(m) == len(e) and np.allclose(m, toxic / total if len(e) else m)
        expected += moves / total
    assert np.allclose(toxicity._joint(crf, np.concatenate(found), inner), expected)
    long = rng.normal(0, 8, 30_000)
    assert np.allclose(crf.marginals([long[:9], long])[0], crf.marginals([long[:9]])[0])
    ratio = slow = np.exp(long[0])
    (a, b), (c, d) = np.exp(crf.trans - crf.trans.max())
    p, q, s, t = np.exp(long) * d, np.exp(long) * b, np.full(len(long), c), np.full(len(long), a)
    p[0], q[0], s[0], t[0] = 0, ratio, 0, 1
    for k, r in enumerate(toxicity._ratios(p, q, s, t)):
        slow = slow if not k else math.exp(long[k]) * (b + slow * d) / (a + slow * c)
        assert math.isclose(r, slow, rel_tol=1e-9)


def test_toxicity_sample_is_of_documents_with_labels(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, f"{some(rng, 20)} {('vile nasty brute' if k % 2 else 'calm gentle soul')} {some(rng, 20)}", k) for k in range(300)], "doc_id long, text string, h int")
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs.union(docs), labels).collect()
    assert len(rows) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(300))
    judged = toxicity.judge(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in judged) and len(judged) == 300


def test_records_equal_the_tokenizer(spark, table, odd, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    peer, made = Tokenizer.from_file(path), records.Encoder(path)
    for r in [*(x[1] or "" for x in odd), *(x.text or "" for x in read(spark, sf_dir, "documents").collect())]:
        assert np.frombuffer(made.encode(r), f"<u{made.width}").tolist() == peer.encode(r, add_special_tokens=False).ids
    assert made.by_word
    for r in ("a <|endoftext|> b", "one<|startoftext|>two <|ENDOFTEXT|>", "<|endoftext|", "end <|endoftext|><|endoftext|>."):
        assert np.frombuffer(made.encode(r), f"<u{made.width}").tolist() == peer.encode(r, add_special_tokens=False).ids
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain = records.Encoder(other)
    assert not plain.by_word and np.frombuffer(plain.encode("Two  words.\n"), "<u2").tolist() == Tokenizer.from_file(other).encode("Two  words.\n", add_special_tokens=False).ids
    index = records.token_records(table.select("doc_id", "text"), path, end_id=2).collect()
    assert len(index) == len(odd)
    ordered = sorted(index, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([r.doc_id for r in index], key=lambda d: (d is not None, d or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    texts = {(d, zlib.crc32(np.array([*peer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, *_ in odd}
    assert {(r.doc_id, r.ids_crc32) for r in index} == texts


def test_frames_show_damage():
    good = records.frame(b"payload") + b"\n"
    assert records.read_frame(good, 0) == (b"payload", len(good))
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(Exception):
            records.read_frame(bytes(bad), 0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination(spark, table):
    rng = random.Random(11)
    items = [(k, some(rng, n)) for k, n in enumerate([8, 20, 20, 45, 80, 3, 1])] + [(7, None), (8, ""), (None, "none of these")]
    docs, want = [], set()
    for k in range(80):
        ws, item = some(rng, 150).split(), k % 7
        own = items[item][1].split()
        n = len(own)
        if k < 70:
            for _ in range((k // 7) % (decontam.allowed(n) + 1)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([["xx"], [], [own[at], "yy"]])
            if distance(own, items[item][1].split()) <= decontam.allowed(n):
                want.add((k, item))
            ws[50:50] = own
        docs.append((k, " ".join(ws), None, None, None, None, None))
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    big = {p for p in want if p[1] not in (5, 6)}
    assert big <= pairs and {p for p in want if p[1] == 5} <= pairs
    whole = {d: t for d, t, *_ in docs}
    texts = dict(items)
    for r in found:  # each place is one, by plain edit distance
        assert distance(texts[r.item_id].split(), whole[r.doc_id][r.start : r.end].split()) == r.edits <= decontam.allowed(r.item_words)
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(whole) - {p[0] for p in pairs}
    assert decontam.decontaminate(table, bench.limit(0)).count() == table.count()


def test_decontamination_recall_at_the_limit():
    """Every item size at its limit and at half of it, each item against each document, by brute force."""
    fresh = iter(range(10**6))
    for n in (8, 10, 13, 16, 20, 31, 45, 80, 150, 300):
        for share in (1, 0.5):
            rng = random.Random(n)
            items = [some(rng, n) for _ in range(40)]
            embedded, caught = decontam.Items(list(enumerate(items))), 0
            for k, item in enumerate(items):
                own = item.split()
                for _ in range(int(decontam.allowed(n) * share)):
                    at = rng.randrange(len(own))
                    own[at : at + 1] = rng.choice([[f"new{next(fresh)}"], [], [own[at], f"new{next(fresh)}"]])
                ws = some(rng, 120).split()
                ws[60:60] = own
                found = decontam._places(embedded, [k], [0], [" ".join(ws)])
                caught += any(r[1] == k for r in found)
                for _, i, first, last, edits, *_ in found[:3]:
                    assert distance(items[i].split(), " ".join(ws)[first:last].split()) == edits <= decontam.allowed(n)
            assert caught >= 0.95 * len(items), (n, share, caught)
    assert decontam.SETS == decontam.planned_sets() and decontam.planned_sets(recall=0.999) > decontam.SETS > decontam.planned_sets(recall=0.3)


def test_substring_dedup(spark):
    rng = random.Random(17)
    passage, line, docs = some(rng, 60), some(rng, 90), []
    for k in range(40):
        body = some(rng, 200).split()
        if k % 4 == 0:
            body[100:100] = passage.split()
        text = " ".join(body)
        if k % 5 == 0:
            own = line.split()
            own[rng.randrange(3)] = "edited"
            text += "\n" + " ".join(own)
        docs.append((k, text, None, None, None, None, None))
    docs += [(40, None, None, None, None, None, None), (41, "", None, None, None, None, None), (42, docs[1][1], None, None, None, None, None), docs[2], (None, docs[1][1], None, None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    cut = {r.doc_id: r.text for r in substring.remove_repeats(df).collect() if r.doc_id is not None}
    whole = {d: t for d, t, *_ in docs if d is not None}
    assert cut[40] is None and cut[41] == "" and cut[42] == ""
    for k in range(40):
        assert (passage in cut[k]) == (k == 0)  # the first copy stays
        if k % 4 and k % 5:
            assert cut[k] == whole[k]  # nothing else goes
        if k % 5 == 0 and k:
            assert len(cut[k].split()) <= 203
    for r in substring.repeated_passages(df).collect():
        assert r.kept_doc_id <= r.doc_id and 0 <= r.start < r.end <= len(whole[r.doc_id])
    assert substring.remove_repeats(df).count() == len(docs)


def test_repeated_lines_by_brute_force(spark):
    """Lines of one template, which meet in the bands without being alike, and near copies of some of them; long lines and short."""
    rng = random.Random(29)
    lines = []
    for size, part in ((90, 40), (90, 0), (30, 14), (30, 0)):
        template = some(rng, part)
        for _ in range(70):
            own = (template + " " + some(rng, size - part)).split()
            lines.append(own)
            if rng.random() < 0.7:
                copy = list(own)
                for _ in range(1 if size == 30 else rng.choice((1, 2))):
                    copy[rng.choice((rng.randrange(3), size - 1 - rng.randrange(3)))] = "edited"
                lines.append(copy)
    rng.shuffle(lines)
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in lines]
    twice = {k for k in range(len(lines)) if any(5 * len(sets[j] & sets[k]) >= 4 * len(sets[j] | sets[k]) for j in range(k))}
    rows = [(k, f"{some(rng, 12)}\n{' '.join(ws)}\n{some(rng, 9)}") for k, ws in enumerate(lines)]
    got = {r.doc_id: r.text for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    lost = {k for k, t in got.items() if len(t.split("\n")[1].split()) < len(lines[k]) // 2}
    runs = [{tuple(ws[k : k + substring.LEAST]) for k in range(len(ws) - substring.LEAST + 1)} for ws in lines]
    assert len(twice) > 100 and len(twice & lost) >= 0.97 * len(twice), len(twice & lost) / len(twice)
    assert all(any(runs[j] & runs[k] for j in range(k)) for k in lost - twice)  # a repeated stretch


def test_shards(spark, table, odd):
    got = sharding.shuffle_into_shards(table.select("doc_id", "text"), shards=16).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r["__shard"]].append(r["__slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, got)) == sorted((str(r[0]), str(r[1])) for r in odd)
    hot = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    assert sharding.shuffle_into_shards(hot, shards=4).groupBy("__shard").count().filter("count = 5000").count() == 4
    twice = [sorted((r.doc_id, r["__shard"], r["__slot"]) for r in sharding.shuffle_into_shards(spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))).collect()) for _ in range(2)]
    assert twice[0] == twice[1] and [d for d, *_ in sorted(twice[0], key=lambda r: (r[2], r[1]))] != list(range(500))


def test_forest_equals_sql(spark, table, odd, tmp_path):
    rng = random.Random(23)
    rows = [(r[0], r[1]) for r in odd if r[0] is not None]
    centre = some(rng, 200).split()
    for k in range(150):  # a large group of near copies
        ws = list(centre)
        for _ in range(k % 4):
            ws[rng.randrange(len(ws))] = f"w{k}"
        rows.append((1000 + k, " ".join(ws)))
    rows = sorted(set(rows), key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "documents")
    df.write.parquet(path)
    want = duckdb.sql(queries._FOREST.replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    got = forest.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    left = forest.drop_near_duplicates(table)
    assert left.columns == table.columns and left.filter("doc_id IS NULL").count() == 2
    assert left.filter("doc_id IS NOT NULL").count() == left.filter("doc_id IS NOT NULL").select("doc_id").distinct().count()


def test_forest_finds_every_link_of_crowds(spark):
    """A tree of chained copies and a star of copies too far from each other, against all pairs."""
    rng = random.Random(31)
    fresh = iter(range(10**6))

    def edited(ws, n):
        out = list(ws)
        for k in rng.sample(range(len(out)), n):
            out[k] = f"x{next(fresh)}"
        return out

    tree = [[f"t{k}" for k in range(200)]]
    while len(tree) < 1500:
        tree.append(edited(rng.choice(tree), rng.choice((2, 3))))
    centre = [f"s{k}" for k in range(200)]
    texts = tree + [centre] + [edited(centre, 4) for _ in range(900)]
    rng.shuffle(texts)
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in texts]
    number = {}
    sets = [{number.setdefault(g, len(number)) for g in x} for x in sets]
    first = list(range(len(texts)))  # the smallest document of each one's component
    for k, x in enumerate(sets):
        for j in range(k):
            if first[j] != first[k] and 100 * (both := len(x & sets[j])) >= 85 * (len(x) + len(sets[j]) - both):
                low, high = sorted((first[j], first[k]))
                first = [low if c == high else c for c in first]
    df = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(df).collect()}
    assert {k for k, c in enumerate(first) if got[k] != c} == set()


def test_forest_with_more_partitions_than_classes(spark):
    rng = random.Random(41)
    centre = some(rng, 200).split()
    rows = [(k, " ".join([*centre[: 50 * k], *([f"w{k}"] if k else []), *centre[50 * k + 1 if k else 0 :]])) for k in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.component_id for r in got} == {0} and len(got) == 4


def test_forest_links_that_prefixes_alone_find(spark, monkeypatch):
    """With no neighbours of a tree every link is one of the last search, also among rows that share an id."""
    rng = random.Random(43)
    centre = some(rng, 200).split()
    rows = [(k, " ".join([*centre[: 40 * k + 9], f"w{k}", *centre[40 * k + 10 :]])) for k in range(4)]
    rows += [(3, some(rng, 90)), (7, some(rng, 90))]
    rows += [(8, rows[4][1]), (9, None)]
    monkeypatch.setattr(forest, "_neighbours", lambda trees, agreement: spark.createDataFrame([], "a long, ath long, b long, bth long"))
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 0), (7, 7), (8, 0), (9, 9)} and len(got) == len(rows)


def test_columns_of_our_own_names(spark):
    """Columns that are named like those the operators work with come back as they were."""
    rng = random.Random(3)
    names = ["doc_id", "text", "id", "th", "n", "n_", "place", "bucket", "spans", "row", "rows", "start", "end", "key", "component", "kept", "prefix", "h", "__id", "__th", "__spans", "__bucket", "ids_"]
    texts = [some(rng, 80) for _ in range(9)]
    texts += [texts[0], texts[1] + " more", some(rng, 40) + " " + texts[2][:400] + " " + some(rng, 30), None, ""]
    rows = [(k, t, *(f"{c}{k}" for c in names[2:])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    bench = spark.createDataFrame([(1, texts[4])], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    outs = {
        "near": forest.drop_near_duplicates(df), "repeats": substring.remove_repeats(df), "leaks": decontam.decontaminate(df, bench), "toxic": toxicity.drop_toxic(df, labels),
        "shards": sharding.shuffle_into_shards(df).drop("__shard", "__slot"), "bpe": bpe.encode_column(df, path, public_tokenizers.PATTERN).drop("ids"),
    }
    for name, out in outs.items():
        assert out.columns == names, name
        for r in out.collect():
            assert tuple(r)[2:] == rows[r.doc_id][2:] and (name == "repeats" or r.text == texts[r.doc_id]), name
    assert {n: o.count() for n, o in outs.items()} == {"near": 12, "repeats": 14, "leaks": 13, "toxic": 14, "shards": 14, "bpe": 14}


def test_empty_tables(spark, table):
    none = table.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outs = [
        audio.audio_digests(none), audio.audio_tensors(none), lm.language_scores(none), html.main_text(pages), toxicity.judge(none, labels), toxicity.drop_toxic(none, labels),
        records.token_records(none.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2), decontam.contaminated(none, bench), substring.repeated_passages(none), substring.remove_repeats(none),
        sharding.shuffle_into_shards(none.select("doc_id", "text")), forest.near_duplicates(none), forest.drop_near_duplicates(none), bpe.encode_column(none, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)


def lines_of_one_template(n: int) -> list[str]:
    """Documents of a line each, and some of two: a tree of edited copies, so many of a band are not alike."""
    rng, fresh, lines, out = random.Random(5), iter(range(10**6)), [[f"t{k}" for k in range(60)]], []
    for k in range(n):
        ws = list(rng.choice(lines[-200:]))
        ws[rng.choice([0, 1, 2, 57, 58, 59, rng.randrange(60)])] = f"x{next(fresh)}"
        lines.append(ws)
        out.append("\n".join(" ".join(x) for x in ([ws] if k % 9 else [ws, rng.choice(lines)])))
    return out


def test_substring_finds_every_line_that_is_alike(spark):
    """Removed lines and clusters against all pairs."""
    texts = lines_of_one_template(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = substring.verified_repeats(df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")).collect()
    assert missed_lines(texts, [(r.a, r.b, r["from"], r.to) for r in rows]) == (0, 0)


def missed_lines(texts: list[str], spans: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """Lines with a partner in an earlier document that no line span has, and pairs of documents that no path of spans joins."""
    lines = [[x.split() for x in t.split("\n")] for t in texts]
    sets = [[{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in x] for x in lines]
    root = list(range(len(texts)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    whole = set()
    for a, b, start, end in spans:
        root[find(b)] = find(a)
        whole |= {(b, l) for l in range(len(lines[b])) if start <= 60 * l and 60 * l + 60 <= end}
    alike = [(j, k, l) for k in range(len(texts)) for j in range(k) for l, x in enumerate(sets[k]) for y in sets[j] if 5 * len(x & y) >= 4 * len(x | y)]
    return len({(k, l) for _, k, l in alike} - whole), sum(find(j) != find(k) for j, k, _ in alike)


def test_sets_of_lines_at_once_are_those_of_each_line():
    """Bands, classes, sizes and prefixes of many lines in whole-array steps, against a loop."""
    rng = np.random.default_rng(47)
    counts = rng.integers(0, 4, 1 << forest.ORDER_BITS).astype(np.uint8)
    sizes = np.array([26, 400, 27, 26, 60, 1000])
    hashes = rng.integers(0, 1 << 63, sizes.sum() + 10, dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes + 5  # words before, between the second and third, and after belong to no line
    starts[2:] += 3
    hashes[starts[1] : starts[1] + 400] = np.tile(hashes[starts[1] : starts[1] + 50], 8)  # a line that repeats itself
    hashes[starts[3] : starts[3] + 26] = hashes[starts[0] : starts[0] + 26]
    keys, classes, n, prefix, ends = substring._line_sets(hashes, starts, sizes, counts)
    for k, (start, size) in enumerate(zip(starts, sizes)):
        s = np.unique(substring.ngram_hashes(hashes[start : start + size], substring.SHINGLE))
        by = np.argsort(counts[(s >> np.uint64(64 - forest.ORDER_BITS)).astype(np.int64)], kind="stable")
        want = s[by[: len(s) - math.ceil(0.8 * len(s)) + 1]].view(np.int64)
        assert n[k] == len(s) and classes[k] == substring._class(s) and prefix[ends[k] - len(want) : ends[k]].tolist() == want.tolist()
        assert (keys[k] == substring.bands(s, np.array([0]))[0]).all()
    assert len(prefix) == ends[-1] and (keys[3] == keys[0]).all() and n[1] == 50


def test_written_tables_leave_no_shuffle_files(spark):
    from millrace.sources.scratch import materialize

    def files() -> set[str]:
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    kept = materialize(spark.range(1000).repartition(4, "id"), "few")
    left = files() - before
    assert not left and kept.count() == 1000
