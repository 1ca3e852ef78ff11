"""Operators that judge each row alone, and sharding and packing, against brute force."""

import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import contamination, licenses, packing, pii, sharding, token_counts, toxicity
from gradeloom.llm.tokens import BYTE_ALPHABET, WordBpe
from tests.llm.conftest import invented, texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ contamination


def brute_hits(text, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    words, cover, named = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for window in {tuple(w[i : i + 13]) for i in range(max(len(w) - 13, 0) + 1)} if w else ():
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    cover.update(range(i, i + len(window)))
                    named.add(item)
    return len(words), len(cover), sorted(named)


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination(spark, docs, block):
    base = texts()[0][1].split()
    items = [("a", " ".join(base[10:30])), ("b", " ".join(base[20:33]).upper()), ("c", "two three"), ("d", None), ("e", ""), ("f", "tha " * 14), ("f", "mixed"), ("", "not there at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = contamination.matches(docs, bench, block_windows=block).collect()
    assert Counter((r.record.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == Counter(
        (i, n, h, tuple(named)) for i, t in texts() for n, h, named in [brute_hits(t, items)]
    )
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    clean = contamination.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not (h and 20 * h >= n) for n, h, _ in (brute_hits(t, items) for _, t in texts()))


def test_contamination_without_benchmark(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {(r.n_hit, len(r.item_ids)) for r in contamination.matches(docs, none).collect()} == {(0, 0)}
    assert contamination.matches(nothing, none).count() == 0


# ---------------------------------------------------------------------------- pii


def brute_spans(t):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return out


def test_pii_base_kinds():
    r, automaton = random.Random(3), pii._automaton()
    for alphabet in ("a@.-+1 ", "12.0", "0123 -4", "+1 (2).-3", "ab@c.d-_%é9\n\U0001f600"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            found = pii.find_spans(t, automaton)
            assert {k: found[k] for k in pii.BASE_KINDS} == brute_spans(t), t
    card = "4111 1111 1111 1111"
    assert pii.find_spans(f"x {card}", automaton)["card"] == [(2, 21)]


def test_pii_added_kinds():
    t = "see https://x.y/z?q=1). IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678 ok, account of the day"
    found = pii.find_spans(t, pii._automaton())
    assert [t[a:b] for a, b in found["url"]] == ["https://x.y/z?q=1"]
    assert [t[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_pii_tables(spark, docs, nothing):
    assert all(not r.spans for r in pii.spans(docs).collect())
    assert pii.spans(nothing).count() == 0
    one = spark.createDataFrame([(1, "é a@b.co, +1 234 567 890.", "z")], "doc_id bigint, text string, spans string")
    assert pii.redacted(one).first().asDict() == {"doc_id": 1, "text": "é <email>, <phone>.", "spans": "z"}


# ------------------------------------------------------------------------ toxicity


def labelled(n: int, seed: int):
    r = random.Random(seed)
    stems = ["worthless", "idiotic", "scumbag"]
    for i in range(n):
        words = invented(seed * 10_000 + i, r.randint(20, 120)).split()
        if toxic := i % 2:
            for _ in range(1 + len(words) // 20):
                words.insert(r.randrange(len(words)), r.choice(stems) if seed == 1 else r.choice(["w0rthless", "idiotics", "scumbags"]))
        yield " ".join(words), toxic


def test_toxicity_learns_and_reads_misspellings():
    text, toxic = map(list, zip(*labelled(400, 1)))
    model = toxicity.fit(map(toxicity.bag_of, text), toxic, prior=0.1)
    for seed in (1, 2):
        text, toxic = map(list, zip(*labelled(200, seed)))
        score = np.array(toxicity.Scorer(model).score(text))
        assert ((score >= 0.5) == np.array(toxic)).mean() > 0.9
    assert toxicity.Scorer(model, most=3).score(text) == pytest.approx(score.tolist())
    assert toxicity.Scorer(model).score(["", None, "..."]) == pytest.approx([0.1] * 3)


def test_toxicity_tables(spark, docs, nothing):
    rows = [(100 + i, t) for i, (t, _) in enumerate(labelled(200, 1))]
    train = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(100 + i, y) for i, (_, y) in enumerate(labelled(200, 1))] + [(None, 1), (101, None), (100, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(train, labels)
    clean = {i for i, _ in rows} - {100, *(100 + i for i, (_, y) in enumerate(labelled(200, 1)) if y)}
    kept = {r.doc_id for r in toxicity.keep_clean(train, labels).collect()}
    assert len(clean - kept) <= 5 and len(kept - clean) <= 5  # the held-out ones included, at the settings of the query
    scores = toxicity.scored(docs, model).collect()
    assert len(scores) == len(texts()) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.keep_clean(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.scored(nothing, model).count() == 0
    sample = toxicity.sample(train, labels, toxicity.Params(sample_per_class=10))
    assert sample.count() == 20 and not sample.select(toxicity.held_out("id").alias("h")).filter("h").count()


def test_toxicity_learns_words_that_few_documents_hold():
    """Every toxic document has an insult, each insult in four documents only: nothing rare is left out."""
    insults = ["worthless", "idiotic", "scumbag", "moronic", "pathetic", "garbagey"]
    text = [invented(k, 40) for k in range(240)] + [f"{invented(1000 + k, 20)} {insults[k % 6]} {invented(2000 + k, 20)}" for k in range(24)]
    toxic = [0] * 240 + [1] * 24
    scorer = toxicity.Scorer(toxicity.fit(map(toxicity.bag_of, text), toxic))
    assert ((np.array(scorer.score(text)) >= 0.5) == np.array(toxic)).mean() == 1.0
    nothing_known = scorer.score([""])[0]  # what an n-gram that is left out adds up to
    assert all(scorer.score([w])[0] > 1.5 * nothing_known for w in insults)


def test_toxicity_bags():
    text = "You, you YOU are\u00a0so  'so' kind!"
    words, counts = toxicity.bag_of(text)
    assert dict(zip(words.split(), np.frombuffer(counts, np.int32).tolist())) == Counter(toxicity.words_of(text)) == {"you": 3, "are": 1, "so": 2, "kind": 1}
    assert toxicity.bag_of(None) == toxicity.bag_of("...") == ("", b"")
    silent = toxicity.fit([("", b"")] * 4, [0, 1, 0, 0])
    assert toxicity.Scorer(silent).score(["anything at all"]) == pytest.approx([0.25])


def test_toxicity_trains_as_a_plain_loop_does():
    """The same steps, one document, word and n-gram at a time."""
    p = toxicity.Params(buckets=1 << 12, dim=2, epochs=6)
    text, toxic = ["you are so mean", "so kind you are", "mean mean words", "kind words here", "", "here you are"], [1, 0, 1, 0, 0, 0]
    model = toxicity.fit(map(toxicity.bag_of, text), toxic, p, 0.2)
    grams = {w: toxicity.subwords([w], p)[0].tolist() for t in text for w in t.split()}
    docs_with = Counter(g for t in text for g in {g for w in t.split() for g in grams[w]})
    rows = sorted(docs_with)
    rng = np.random.default_rng(p.seed)
    first = rng.normal(0, 0.1 / p.scale, (len(rows), p.dim)).astype(np.float32).tolist()
    w = [list(map(float, np.float32(x))) for x in rng.normal(0, 1.0, (p.dim, 2))]
    e = dict(zip(rows, first))
    bias = [0.0, math.log(0.2 / 0.8)]
    moments = {}

    def moved(key, gradient, rate, epoch):
        m, v = moments.get(key, (0.0, 0.0))
        m, v = m + 0.1 * (gradient - m), v + 0.01 * (gradient * gradient - v)
        moments[key] = m, v
        return rate * (m / (1 - 0.9**epoch)) / (math.sqrt(v / (1 - 0.99**epoch)) + 1e-8)

    for epoch in range(1, p.epochs + 1):
        rate = p.rate * (1 - (epoch - 1) / p.epochs)
        d_e, d_w = {g: [0.0] * p.dim for g in rows}, [[0.0, 0.0] for _ in range(p.dim)]
        for t, y in zip(text, toxic):
            words = t.split()
            x = [sum(p.scale * sum(e[g][d] for g in grams[k]) / len(grams[k]) for k in words) / (len(words) + p.pad) for d in range(p.dim)]
            logits = [sum(x[d] * w[d][c] for d in range(p.dim)) + bias[c] for c in (0, 1)]
            total = sum(map(math.exp, logits))
            weight = 1 / (2 * toxic.count(y))
            slope = [(math.exp(logits[c]) / total - (c == y)) * weight for c in (0, 1)]
            for d in range(p.dim):
                back = sum(slope[c] * w[d][c] for c in (0, 1))
                for c in (0, 1):
                    d_w[d][c] += x[d] * slope[c]
                for k in words:
                    for g in grams[k]:
                        d_e[g][d] += p.scale * back / (len(words) + p.pad) / len(grams[k])
        for g in rows:
            trust = docs_with[g] / (docs_with[g] + p.doubt)
            e[g] = [e[g][d] - trust * moved((g, d), d_e[g][d] + p.decay * e[g][d], rate, epoch) for d in range(p.dim)]
            norm = math.sqrt(sum(v * v for v in e[g])) + 1e-12
            e[g] = [v * max(0.0, 1 - p.shrink * rate / norm) for v in e[g]]
        w = [[w[d][c] - moved((d, c, "w"), d_w[d][c] + p.decay * w[d][c], rate, epoch) for c in (0, 1)] for d in range(p.dim)]
    expected = np.zeros(p.buckets)
    for g in rows:
        expected[g] = p.scale * sum(e[g][d] * (w[d][1] - w[d][0]) for d in range(p.dim))
    assert np.abs(expected).max() > 1 and np.allclose(model.share, expected, rtol=2e-3, atol=2e-3 * np.abs(expected).max())
    assert model.bias == pytest.approx(bias[1], rel=1e-6)


# ------------------------------------------------------------------- token counts


def brute_pieces(word, vocabulary, end="</w>"):
    symbols, k, n = [*word, end], 0, 0
    while k < len(symbols):
        longest = next((j for j in range(len(symbols), k, -1) if "".join(symbols[k:j]) in vocabulary), None)
        if longest is None:
            return 1
        k, n = longest, n + 1
    return n


def test_automaton():
    r = random.Random(5)
    for _ in range(150):
        vocabulary = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) + r.choice(["", "</w>"]) for _ in range(r.randint(1, 25))}
        automaton = token_counts.Automaton(vocabulary)
        for _ in range(60):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 12)))
            assert automaton.count(word) == brute_pieces(word, vocabulary), (vocabulary, word)


def test_token_counts(docs, nothing):
    vocabulary = set(token_counts.vocabulary_of(VOCABULARY))
    wanted = []
    for i, t in texts():
        words = token_counts.WORD.findall((t or "").lower())
        short = [w for w in words if len(w) < 1000]
        if short == words:
            wanted.append((i, len(words), sum(brute_pieces("".join(BYTE_ALPHABET[b] for b in w.encode()), vocabulary) for w in words)))
    got = [(r.record.doc_id, r.n_words, r.n_pieces) for r in token_counts.counted(docs, VOCABULARY).collect()]
    assert Counter(g for g in got if g[0] != 19) == Counter(wanted)
    assert token_counts.counted(nothing, VOCABULARY).count() == 0


# ------------------------------------------------------------------------- tokens


def test_word_ids_equal_the_library():
    own, library = WordBpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    r = random.Random(1)
    alphabet = "aB'sST tdé ÀŸſßİı\x85\xa0\x1c\x00<|endoftext|>9²¼!?.-_\n\tΣσ中́ﬁ"
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    cases += [x for c in map(chr, range(0x180)) for x in (c, f"a{c}b", f"'{c}", c + c)] + [t or "" for _, t in texts()]
    for text in cases:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


# ------------------------------------------------------------------------ packing


def test_plan_covers_the_histogram():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 20_000):
        sizes, counts = np.unique(r.integers(1, 65, n), return_counts=True)
        histogram = dict(zip(sizes.tolist(), counts.tolist()))
        plan = packing.plan(histogram, 64)
        got = Counter()
        for times, pattern in plan:
            assert sum(s * k for s, k in pattern.items()) <= 64
            for s, k in pattern.items():
                got[s] += times * k
        assert got == Counter(histogram)
        if n >= 300:
            least = -(-sum(s * k for s, k in histogram.items()) // 64)
            assert sum(t for t, _ in plan) <= 1.03 * least + 1


def test_best_pattern():
    value, counts = packing.best_pattern(np.array([1.0, 2.5, 4.0]), np.array([3, 5, 9]), 14)
    assert value == pytest.approx(6.5) and counts.tolist() == [0, 1, 1]


def test_packing(docs, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs, VOCABULARY, with_ids=True, bucket_rows=4).collect()
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        found[r.id].append((r.start, r.doc_tokens, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1].tolist()] and sum(n for _, n in pieces) <= 2048
    for i, t in texts():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        if [x for x, _ in texts()].count(i) == 1:
            assert b"".join(p for _, _, p in sorted(found[i])) == ids and {n for _, n, _ in found[i]} == {len(ids) // 4}
    assert packing.pack(nothing, VOCABULARY).count() == 0


# ----------------------------------------------------------------------- sharding


@pytest.mark.parametrize("bucket", [16 << 20, 3000])
def test_sharding(docs, nothing, bucket):
    out = sharding.shards(docs, 5, bucket_bytes=bucket)
    rows = out.collect()
    assert Counter((r.doc_id, r.text, r.score) for r in rows) == Counter((i, t, "s") for i, t in texts())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3, 4]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shards(nothing, 5).count() == 0


def test_sharding_mixes(spark):
    rows = sharding.shards(spark.range(4000).selectExpr("id", "'t' AS text"), 4).collect()
    inside = [r.id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(inside, range(4000))[0, 1]) < 0.1


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(texts())


# ----------------------------------------------------------------------- licences


def test_licenses(spark, nothing):
    mit = dict((len(t), t) for n, t in licenses.TEMPLATES if n == "MIT")
    full = mit[max(mit)]
    rows = [
        (1, "intro text\nReleased under the MIT license\nmore"), (2, f"Copyright someone\n\n{full}\n\nand then some code follows here"), (3, None), (4, ""),
        (5, "nothing to see"), (6, full.lower()), (7, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."), (8, "mit"),
        (9, "word " * 30000),
    ]
    got = {(r.id, r.license_id): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "MIT"), (7, "GPL-3.0"), (7, "CC-BY-NC-4.0")}
    assert got[1, "MIT"] == 1.0 and got[2, "MIT"] == 1.0
    assert licenses.scan(nothing).count() == 0
    assert licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=(("x", ""),)).count() == 0


def test_licenses_over_several_paragraphs(spark):
    """Full notices in longer files, in their usual paragraphs and wrapped lines."""
    full = {n: max((t for m, t in licenses.TEMPLATES if m == n), key=len) for n in ("MIT", "GPL-3.0", "BSD-3-Clause")}
    assert "Neither the name" in full["BSD-3-Clause"]
    code = "\n".join(invented(i, 12) for i in range(15))
    wrapped = lambda t: "\n".join(textwrap.wrap(t, 70))
    cut = {"MIT": ("The above", "THE SOFTWARE IS"), "GPL-3.0": ("This program is distributed", "You should"), "BSD-3-Clause": ("1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE")}
    rows = []
    for k, (name, text) in enumerate(full.items()):
        paragraphs = text
        for at in cut[name]:
            paragraphs = paragraphs.replace(at, "\n\n" + at, 1)
        rows.append((2 * k, f"{code}\n\n{paragraphs}\n\n{code}"))
        rows.append((2 * k + 1, "\n\n".join([code, *map(wrapped, paragraphs.split("\n\n")), code])))
    got = {(r.id, r.license_id): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {(2 * k + j, n) for k, n in enumerate(full) for j in (0, 1)}
    assert all(d > 0.99 for d in got.values())


def test_every_licence_match_holds_a_cue_word():
    words = [t.lower().replace(".", " ").split() for _, t in licenses.TEMPLATES]
    cues = set(licenses.cue_words(words, 0.8))
    r = random.Random(4)
    for own in words:
        pairs = list(zip(own, own[1:]))
        distinct = set(pairs)
        for _ in range(50):
            part = [w for w in own if r.random() < 0.9]
            shared = len(set(zip(part, part[1:])) & distinct)
            if 2 * shared >= 0.8 * (len(set(zip(part, part[1:]))) + len(distinct)):
                assert cues & set(part)


def test_shard_names_that_clash_are_refused(spark):
    with pytest.raises(ValueError):
        sharding.shards(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, Slot int"), 3)


def test_account_cues_in_linear_time():
    start = time.time()
    pii.find_spans("ACCOUNT-" * 40_000, pii._automaton())
    assert time.time() - start < 10
