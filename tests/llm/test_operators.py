"""Contract of each operator against plain definitions, and its defined edge cases."""

import hashlib
import re
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import LINE, clashing, texts_of
from pyspark.sql import functions as F

from riskgrain.llm import (
    bpe, chat, decontaminate, ftrl, graph, jaccard, language, license_scan, line_dedup, pii, quality, toxicity,
)
from riskgrain.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r[0]: r for r in df.collect()}


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


# every operator on every odd table

def operators(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (4, None, 1), (10, 1, 0), (11, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, LINE), (2, None), (3, ""), (4, "two words"), (None, "own words of number")], "item_id long, text string")
    return {
        "license": license_scan.scan, "language": language.identify, "accepted": language.accepted,
        "lines": line_dedup.deduplicate_lines, "toxicity": lambda d: toxicity.score(d, labels),
        "benchmark": lambda d: decontaminate.contaminated(d, items), "clean": lambda d: decontaminate.clean(d, items),
        "bpe": lambda d: bpe.round_trip(d, VOCABULARY), "quality": quality.quality_rules, "pii": pii.find,
        "jaccard": jaccard.similarity_classes, "near": jaccard.without_near_copies,
    }


@pytest.mark.parametrize("name", [
    "license", "language", "accepted", "lines", "toxicity", "benchmark", "clean", "bpe", "quality", "pii", "jaccard", "near"])
def test_odd_tables(spark, messy, empty, name):
    run = operators(spark)[name]
    plain = run(messy).collect()
    assert run(empty).count() == 0
    mixed = run(clashing(messy))
    assert len(mixed.columns) == len(set(mixed.columns)) and mixed.count() == len(plain)
    if name in ("license", "language", "lines", "toxicity", "bpe", "quality", "pii", "jaccard"):
        assert len(plain) == messy.count()


# 1

def plain_licenses(text):
    words = WORD.findall(text.translate(LOWER))
    found = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(words))
             if words[k:k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(k for k, _ in found), ",".join(sorted({label for _, label in found}))


def test_license_places(spark, documents, messy):
    more = spark.createDataFrame([
        (900, "All rights reserved. All RIGHTS reserved, all rights. CC-BY cc by by"),
        (901, "x Licensed under the Apache License, Version 2.0."), (902, "general public general public license")], "doc_id long, text string")
    for docs in (documents, messy.where("doc_id IS NOT NULL"), more):
        found = by_id(license_scan.scan(docs))
        for doc, text in texts_of(docs).items():
            n, starts, labels = plain_licenses(text)
            r = found[doc]
            assert (r["n_words"], sorted(k for p in r["places"] for k in p), r["phrase_labels"]) == (n, starts, labels), doc
            assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert by_id(license_scan.scan(more))[901]["labels"] == "apache-2.0"


def test_license_words_in_time(spark):
    """The words are those of the pattern, in well under the time of a search for it."""
    odd = [None, "", " ", "--", "a", " A ", "Ünder-É;2.0", "x\U0001F600Y z\u2028\u00a0q", "a\x00B\x7f\x80", "\u212Ab `c{d}", "\nend\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "id long, text string")
    found = {r["id"]: r["w"] for r in rows.select("id", license_scan.words_of(F.col("text")).alias("w")).collect()}
    assert found == {k: WORD.findall((t or "").translate(LOWER)) for k, t in enumerate(odd)}

    many = spark.range(6_000).repartition(8).select(F.concat(F.repeat(F.lit("Licensed under the terms, "), 200), F.col("id").cast("string")).alias("text"))

    def seconds(words):
        took = []
        for _ in range(3):
            start = time.time()
            assert many.agg(F.sum(F.size(words))).first()[0] == 6_000 * 801
            took.append(time.time() - start)
        return min(took)

    searched = seconds(F.regexp_extract_all(F.lower("text"), F.lit(WORD.pattern), F.lit(0)))
    assert seconds(license_scan.words_of(F.col("text"))) < 0.7 * searched


def test_license_templates_against_search(documents, messy):
    """A document gets a template's label exactly if its mandatory phrases stand as in the template."""
    phrases = set(license_scan.PHRASES.values())
    for docs in (documents, messy.where("doc_id IS NOT NULL")):
        found = by_id(license_scan.scan(docs))
        for doc, text in texts_of(docs).items():
            assert set(filter(None, found[doc]["labels"].split(","))) - phrases == plain_templates(text) - phrases, doc


def test_license_votes(spark):
    """A word out of its place, a phrase cut in two, letters that only look like A to Z, and a template of words alone."""
    notice = license_scan.TEMPLATES["mpl-2.0"][0][0]
    rows = [
        (1, notice), (2, notice.replace("public", "very public")), (3, "mozilla " * 50 + "license public " + notice + " license"),
        (4, notice.replace("mozilla", "mozilLa").replace("license", "LICENSE")), (5, notice.replace("license", "li\u0441ense")),
        (6, "wor\u212A under the \u212Ay phrase"), (7, "work under the key phrase")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(license_scan.scan(docs))
    assert {d for d, r in found.items() if "mpl-2.0" in r["labels"].split(",")} == {1, 3, 4}
    found = by_id(license_scan.scan(docs, phrases={"key phrase": "key"}, templates={"whole": [("work under the", [])]}))
    assert {d: r["labels"] for d, r in found.items()} == {**{d: "" for d in range(1, 7)}, 7: "key,whole"}


def plain_templates(text):
    """Labels of the templates whose mandatory phrases stand at their places."""
    words, labels = WORD.findall(text.translate(LOWER)), set()
    for label, bodies in license_scan.TEMPLATES.items():
        for template, keys in bodies:
            t, keys = template.split(), [k.split() for k in keys]
            offsets = [next(i for i in range(len(t)) if t[i:i + len(k)] == k) for k in keys]
            if any(all(s + o >= 0 and words[s + o:s + o + len(k)] == k for o, k in zip(offsets, keys)) for s in range(-len(t), len(words))):
                labels.add(label)
    return labels


def test_license_many_notices(spark, documents):
    """Many notices in one file, and one in a long text that holds every licence word, with the default parameters."""
    notices = {label: [t for t, _ in bodies] for label, bodies in license_scan.TEMPLATES.items()}
    several = ["lgpl", "agpl", "mpl-2.0", "cc0", "bsd", "mit", "unlicense", "apache-2.0"]
    every = sorted({w for ts in notices.values() for t in ts for w in t.split()})
    rows = [
        (930_000, " . ".join(t for ts in notices.values() for t in ts)), (930_001, " . ".join(notices[x][0] for x in several)),
        (930_002, " filler ".join(every * 40) + " so " + notices["apache-2.0"][0] + " so " + " ".join(f"w{k}" for k in range(20_000))),
        (930_003, " ".join(every)), (930_004, "mit license"), (930_005, "Apache License, Version 2.0, then text")]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found, phrases = by_id(license_scan.scan(docs)), set(license_scan.PHRASES.values())
    for doc, text in texts_of(docs).items():
        assert set(filter(None, found[doc]["labels"].split(","))) - phrases == plain_templates(text) - phrases, doc
    assert set(notices) <= set(found[930_000]["labels"].split(",")) and set(several) <= set(found[930_001]["labels"].split(","))


# 2 and 5

def test_language_held_out(spark, documents):
    found = by_id(language.identify(documents))
    held = [(r["lang"], found[r["doc_id"]]) for r in documents.collect() if found[r["doc_id"]]["held_out"]]
    assert sum(lang == r["lang_pred"] for lang, r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_letters(messy):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(messy).collect()}
    assert {(1, "und"), (2, "und"), (6, "und")} <= found
    assert {1, 2, 6}.isdisjoint(r["doc_id"] for r in language.accepted(messy).collect())


def test_ftrl_prunes_noise():
    draw = np.random.default_rng(1)
    rows, targets = [], []
    for _ in range(400):
        y = draw.integers(2)
        rows.append((np.array([y, 2 + draw.integers(50)]), np.ones(2)))
        targets.append(np.eye(2)[y])
    w = ftrl.Ftrl(52, 2, l1=1.0).fit(rows, np.array(targets), 3)
    assert abs(w[:2]).min() > 0.5 and (w[2:52] == 0).mean() > 0.8


def test_temperature_sharpens_and_softens():
    truth = np.array([0, 1] * 50)
    sure = np.where(np.arange(2)[None, :] == truth[:, None], 1.0, 0.0)
    assert ftrl.temperature(sure, truth) < 0.1
    wrong = np.concatenate([truth[:60], 1 - truth[60:]])
    assert ftrl.temperature(10 * sure, wrong) > 5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = by_id(toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels))
    rows = [(r["toxic"], found[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in found]
    pairs = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for t, a in rows if t == 1 for u, b in rows if u == 0]
    assert np.mean(pairs) > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for _, r in rows)


def test_toxicity_moments_of_different_texts(spark, monkeypatch):
    """Documents that share a passage count each, copies once, in the moments and in the prior."""
    passage = " ".join(f"common{k}" for k in range(60))
    own = [" ".join(f"own{k}x{n}" for n in range(40)) for k in range(300)]
    rows = [(k, f"{passage} {'vileword' if k % 3 == 0 else 'kind'} {own[k]}", int(k % 3 == 0)) for k in range(300)]
    rows += [(1000 + k, t, y) for k, t, y in rows if k % 6 == 0]
    docs, seen = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), {}

    class Seen(toxicity.LabelModel):
        def __init__(self, moments, prior, rates):
            seen.update(moments=moments, prior=prior)
            super().__init__(moments, prior, rates)

    monkeypatch.setattr(toxicity, "LabelModel", Seen)
    toxicity.score(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    learned = {r[0] for r in docs.where(~toxicity.is_held_out("doc_id", 4, 2)).select("doc_id").collect()}
    texts = {t: y for k, t, y in rows if k in learned}
    assert np.isclose(seen["prior"], np.mean(list(texts.values())))
    assert np.isclose(seen["moments"].diagonal()[0], np.mean(["vileword" in t for t in texts]))


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(2)
    n, prior, hit, slip = 200_000, 0.2, np.array([0.6, 0.4, 0.5, 0.3]), np.array([0.02, 0.05, 0.01, 0.05])
    y = draw.random(n) < prior
    v = draw.random((n, 4)) < np.where(y[:, None], hit, slip)
    v = np.concatenate([v, v[:, :1]], axis=1).astype(float)  # the last voter copies the first
    model = toxicity.LabelModel(v.T @ v / n, prior, np.zeros((5, 2)))
    assert np.allclose(model.given_toxic[1:4], hit[1:], atol=0.06)
    assert model.correlations[0, 4] > 0.1 and model.correlations[1, 2] == 0


# 3

def plain_lines(texts, least=40, docs=5):
    held = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, text in texts.items():
        for line in text.split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(doc)
    gone = {k: max(d) for k, d in held.items() if len(d) >= docs}
    return {doc: (len(text.split("\n")), [x for x in text.split("\n") if gone.get(key(x), doc) == doc]) for doc, text in texts.items()}


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines(documents, messy, batches, fanout):
    docs = documents.select("doc_id", "text").unionByName(
        messy.where("doc_id >= 10").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    found = by_id(line_dedup.deduplicate_lines(docs, batches=batches, fanout=fanout).select("doc_id", "text", "n_lines", "n_dropped"))
    for doc, (n, kept) in plain_lines(texts_of(docs)).items():
        assert tuple(found[doc])[1:] == ("\n".join(kept), n, n - len(kept)), doc


# 4

def plain_chat(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn if turn is not None else -1, role or "", text or ""))
    return {c: sorted(t) for c, t in turns.items()}


@pytest.mark.parametrize("budget, chunk", [(1024, 64), (60, 4)])
def test_chat_round_trip(spark, sf, budget, chunk):
    odd = [(-2, k, "assistant" if k % 2 else "user", f"<|im_end|>\n<\\|x {k} <|") for k in range(150)]
    odd += [(-3, 0, "system", "sys"), (-3, 1, "a\nb\\n<|", None), (-3, 1, "user", "tie"), (-3, None, None, ""), (None, 1, "assistant", "x" * 9000)]
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    formatted = chat.format_chat(rows, budget=budget, chunk=chunk)
    found = by_id(chat.digests(formatted))
    want = plain_chat([tuple(r) for r in rows.collect()])
    assert set(found) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), sha(loss)), conv
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), conv


def test_chat_windows():
    system, turns = ("system", "s" * 8), [("user", "u" * 40), ("assistant", "a" * 40)] * 6
    made = list(chat.windows(system, [], [system, *turns], 60, 2, 0.5))
    assert [t for _, _, new in made for t in new] == [system, *turns]
    for s, old, new in made[1:]:
        assert s == system and len(old) <= 2
        assert sum(chat.tokens(*t) for t in [s, *old, *new]) <= 60
    assert any(old for _, old, _ in made)
    assert chat.format_chat.__doc__


def test_chat_on_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, system string")
    assert chat.digests(chat.format_chat(none)).count() == 0


def test_escape_is_reversible():
    for s in ("", "<|im_start|>", "<\\|", "a<\\\\|b<|", "<<||", "\\<|\\n"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s + "\n")) == s + "\n"


# 6

def test_alignment_against_a_table():
    draw = np.random.default_rng(3)
    for _ in range(40):
        a, b = draw.integers(0, 4, draw.integers(1, 9)), draw.integers(0, 4, draw.integers(0, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


def test_benchmark_copies(spark, documents, benchmark):
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    first = sorted(items)[0]
    words = items[first].split()
    edited = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    more = spark.createDataFrame([(900_001, "before it " + edited + " after it"), (900_002, "nothing of it"), (900_003, None)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    for block_bytes in (10**6, 3000):
        found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, benchmark, block_bytes=block_bytes).collect()}
        assert 0.5 <= found[900_001, first] < 1
        whole = {(doc, item) for doc, text in texts_of(docs).items() for item, t in items.items() if " ".join(WORD.findall(t.translate(LOWER))) in
                 " ".join(WORD.findall(text.translate(LOWER)))}
        assert whole == {pair for pair, score in found.items() if score == 1}
        assert not any(doc in (900_002, 900_003) for doc, _ in found)
    left = texts_of(decontaminate.clean(docs, benchmark))
    assert set(left) == set(texts_of(docs)) - {doc for doc, _ in found}


def edited_copies(words, step):
    """Copies with every ``step``-th word replaced, with a word put in there, and without it."""
    return [
        [w if k % step else f"changed{k}" for k, w in enumerate(words, 1)],
        [x for k, w in enumerate(words, 1) for x in ([w] if k % step else [w, f"more{k}"])],
        [w for k, w in enumerate(words, 1) if k % step]]


@pytest.mark.parametrize("whole", [0, 3])
def test_edited_benchmark_copies(spark, documents, benchmark, whole):
    """Every document and item that align are found, as by aligning each of them, with and without whole copies elsewhere."""
    items = {r["item_id"]: decontaminate._words_of(r["text"]) for r in benchmark.collect()}
    plain = {r["item_id"]: WORD.findall(r["text"].translate(LOWER)) for r in benchmark.collect()}
    rows, edited = [], set()
    for item in sorted(items)[:6]:
        for step in (5, 4, 3):
            for k, copy in enumerate(edited_copies(plain[item], step)):
                doc = 910_000 + 100 * item + 10 * step + k
                rows.append((doc, f"before it {' '.join(copy)} after it"))
                edited.add((doc, item))
        rows += [(920_000 + 10 * item + k, f"copy {k} " + " ".join(plain[item])) for k in range(whole)]
    docs = documents.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {}
    for doc, text in texts_of(docs).items():
        words = decontaminate._words_of(text)
        for item, own in items.items():
            score = decontaminate.align(own, words)[0] / 2 / len(own)
            if score >= 0.5:
                want[doc, item] = score
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == want and edited <= set(found)


# 7

@pytest.fixture(scope="module")
def reference_codec():
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(VOCABULARY)
    codec.no_truncation()
    codec.no_padding()
    return codec


def test_bpe_equals_the_library(documents, messy, reference_codec):
    for docs in (documents, messy.where("doc_id IS NOT NULL")):
        found = by_id(bpe.round_trip(docs, VOCABULARY, keep_ids=True))
        for doc, text in texts_of(docs).items():
            ids = reference_codec.encode(text, add_special_tokens=False).ids
            r = found[doc]
            assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == sha(reference_codec.decode(ids, skip_special_tokens=False))


def test_bpe_tree_on_unsplit_text(reference_codec):
    draw = np.random.default_rng(4)
    small = bpe.Codec(VOCABULARY, leaf_chars=7, window_tokens=1)
    alphabets = ["ab", "aeiou ", "don't we'll ", " \n\t", "ä€\U0001f600x", "=-'s", "0123 a", "<|endoftext|> x"]
    for alphabet in alphabets:
        for size in (0, 1, 8, 50, 400):
            text = "".join(draw.choice(list(alphabet), size))
            assert small.encode(text) == reference_codec.encode(text, add_special_tokens=False).ids, repr(text)
            assert small.decode(small.encode(text)) == text
    whole = bpe.Codec(VOCABULARY)
    for text in ("the quick brown" * 20_000, "a" * 50_000, "x<|endoftext|>y " * 5000):
        assert whole.encode(text) == reference_codec.encode(text, add_special_tokens=False).ids


def test_bpe_columns(messy):
    ids = bpe.encode(clashing(messy), VOCABULARY)
    assert ids.columns.count("ids") == 1
    back = bpe.decode(ids, VOCABULARY)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


# 8

def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    n = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base(documents, messy):
    for docs in (documents, messy.where("doc_id IS NOT NULL")):
        found = by_id(quality.quality_rules(docs))
        for doc, text in texts_of(docs).items():
            r, want = found[doc], plain_quality(text)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, doc
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_quality_boilerplate(spark):
    own = [" ".join(f"own{k}x{j}" for j in range(40)) for k in range(30)]
    rows = [(k, f"{LINE}\n{own[k] if k else 'short'}", "h") for k in range(30)] + [(100, f"{LINE}\nand a few more words of its own", "other")]
    found = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not found[0]["kept"] and all(found[k]["kept"] for k in (1, 7, 100)) and found[100]["n_lost"] == 0
    assert found[1]["n_lost"] == len(LINE.split())


# 9

def test_pii_base(documents, messy):
    for docs in (documents, messy.where("doc_id IS NOT NULL")):
        found = by_id(pii.find(docs))
        for doc, text in texts_of(docs).items():
            spans = []
            for kind, pattern in pii.PATTERNS.items():
                for m in pattern.finditer(text):
                    digits = re.sub("[^0-9]", "", m[0])
                    if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                        continue
                    if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                        continue
                    if kind == "phone" and not 8 <= len(digits) <= 15:
                        continue
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
            r = found[doc]
            assert r["base_sha256"] == sha(",".join(spans)) and set(spans) <= set(filter(None, r["spans"].split(",")))


def test_tagger_gradient():
    tagger = pii.Tagger(seed=1)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    draw = np.random.default_rng(5)
    x, y = draw.integers(0, pii.CLASSES, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [5, 6, 6, 0, 0, 7], [0] * 6])
    _, grad = tagger.gradient(x, y)
    for name, index in (("xf", (x[0, 0], 3)), ("hb", (2, 5)), ("o", (1, 1)), ("c", (2,)), ("t", (0, 1))):
        value, step = tagger.p[name][index], 1e-3
        losses = []
        for v in (value + step, value - step):
            tagger.p[name][index] = v
            losses.append(tagger.gradient(x, y)[0])
        tagger.p[name][index] = value
        assert grad[name][index] == pytest.approx((losses[0] - losses[1]) / (2 * step), abs=2e-3)


def test_tagger_learns_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.train(docs)
    table = pii._class_table()
    text = "the other words are here and call 743 555-3824 or (310) 555-4510 today, write to ann.b@mail.example.com soon please and so on"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    spans = pii.tagged_spans(pii._joined_tags(tagger, [codes], table)[0])
    assert any(k == "email" and text[a:e] == "ann.b@mail.example.com" for k, a, e in spans)
    found = total = 0
    for r in docs.where("text LIKE '%@%' OR text LIKE '%+1 (%'").limit(150).collect():
        joined = pii._joined_tags(tagger, [np.frombuffer(r["text"].encode("utf-32-le"), np.uint32)], table)
        tagged = set(pii.tagged_spans(joined[0])) if joined else set()
        base = pii.base_spans(r["text"])
        total, found = total + len(base), found + sum(s in tagged for s in base)
    assert found >= 0.8 * total


def test_reconcile():
    text = "a@b.co (310) 555-4510, 4111 1111 1111 1111"
    base = pii.base_spans(text)
    assert pii.reconcile(text, base, [("email", 0, 6), ("phone", 7, 22), ("phone", 23, 42)]) == [
        ("email", 0, 6), ("card", 23, 42), ("phone", 7, 21)]


# 10

def plain_classes(texts, threshold=0.8):
    sets = {}
    for doc, text in texts.items():
        words = WORD.findall(text.translate(LOWER))
        sets[doc] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root, links = {d: d for d in sets}, Counter()

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(d for d in sets if sets[d])
    for n, a in enumerate(docs):
        for b in docs[n + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= threshold * large and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in sets}


def near_copies(spark, n=60):
    draw = np.random.default_rng(6)
    rows = []
    for group in range(4):
        words = [f"w{group}x{k}" for k in range(120)]
        for k in range(n):
            own = list(words)
            for at in draw.integers(0, 120, 1 + k % 4):
                own[at] = f"e{group}x{k}x{at}"
            rows.append((10_000 + group * 1000 + k, " ".join(own) if k % 5 else " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("rows, grams", [(1024, 1_000_000), (16, 2000)])
def test_jaccard_against_all_pairs(spark, documents, monkeypatch, rows, grams):
    monkeypatch.setattr(jaccard, "TILE_ROWS", rows)
    monkeypatch.setattr(jaccard, "TILE_GRAMS", grams)
    docs = documents.select("doc_id", "text").unionByName(near_copies(spark))
    found = by_id(jaccard.similarity_classes(docs))
    assert {d: (r["class_id"], r["n_links"]) for d, r in found.items()} == plain_classes(texts_of(docs))


def test_jaccard_keeps_one_of_each(spark, messy):
    docs = near_copies(spark, 20)
    kept = {r["doc_id"] for r in jaccard.without_near_copies(docs).collect()}
    assert kept == {d for d, (c, _) in plain_classes(texts_of(docs)).items() if d == c}
    rows = [r["doc_id"] for r in jaccard.without_near_copies(messy).collect()]
    assert rows.count(4) == 1 and rows.count(None) == 2


def test_pruning_bounds():
    needed = jaccard.needed_matches(0.8, 1e-7)
    assert needed == sorted(needed) and 0 < needed[-1] < 0.8 * jaccard.HASHES


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 150: 100, 200: 100}


# queries

def test_query_schemas(spark, sf):
    want = {
        "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op2_language_id": "doc_id held_out lang_pred score", "op3_line_dedup": "doc_id n_lines n_dropped kept_sha256",
        "op4_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op5_toxicity": "doc_id held_out score predicted", "op7_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_jaccard_join": "doc_id class_id n_links",
        "op6_decontamination": "doc_id item_id score",
    }
    assert set(want) == set(QUERIES)
    for name, columns in want.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, sf).columns), name


# missing and shared ids

def test_lines_of_repeated_rows(spark):
    """Documents are counted, not rows; rows without an id are not counted and keep their lines."""
    line, other = LINE + " x" * 10, LINE + " y" * 10
    rows = [(1, line), (1, line), (1, line), (2, line), (2, line), *[(k, other) for k in (3, 4, 5, 6, 7)], (7, other + "\nown"), (None, other), (None, line)]
    found = Counter(tuple(r) for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "text", "n_lines", "n_dropped").collect())
    assert found == Counter(
        [(1, line, 1, 0)] * 3 + [(2, line, 1, 0)] * 2 + [(k, "", 1, 1) for k in (3, 4, 5, 6)] + [(7, other, 1, 0), (7, other + "\nown", 2, 0)]
        + [(None, other, 1, 0), (None, line, 1, 0)])


def test_lines_of_a_text_that_loses_many(spark):
    """A long text whose lines nearly all go, some of them several times."""
    lines = [f"{LINE} number {k}" for k in range(3_000)]
    rows = [(k, "\n".join(lines)) for k in range(6)] + [(-1, "\n".join(["first", *lines, *lines[:50], "last"]))]
    found = {r["doc_id"]: r for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5]["n_dropped"] == 0 and found[-1]["text"] == "first\nlast" and found[-1]["n_dropped"] == 3_050
    assert all(found[k]["text"] == "" and found[k]["n_dropped"] == 3_000 for k in range(5))


def test_quality_of_rows_without_or_with_shared_ids(spark):
    boiler, clean = "one and the same footer line of this very host", " ".join(f"word{k}" for k in range(30))
    rows = [(None, boiler, "h")] * 40 + [(None, clean, "h"), (None, clean + " other", "h")] + [(7, clean + " more", "h"), (7, boiler + "\n" + boiler, "h")]
    rows += [(100 + k, boiler + "\n" + clean + f" {k}", "g") for k in range(5)]
    found = Counter((r["doc_id"], r["n_words"], r["n_lost"], r["kept"]) for r in quality.quality_rules(
        spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert found == Counter({
        (None, 10, 10, False): 40, (None, 30, 0, True): 1, (None, 31, 0, True): 1, (7, 31, 0, True): 1, (7, 20, 20, False): 1, (100, 41, 0, True): 0,
        **{(100 + k, 41, 0, True): 1 for k in range(5)}})


def test_quality_of_a_large_host(spark):
    """A line of many documents is boilerplate even where it is rare among them."""
    line = "a line that stands in a few of the many documents here"
    rows = [(k, (line + "\n" if k < 30 else "") + " ".join(f"w{k}x{j}" for j in range(40)), "big") for k in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.quality_rules(docs).where("n_lost > 0").count() == 0
    assert quality.quality_rules(docs, always=25).where("n_lost = 12").count() == 30


def test_jaccard_of_a_shared_passage(spark, capsys):
    """Texts that share a passage and no more: few pairs are compared, and no component is closed over them."""
    passage = [f"shared{k}" for k in range(40)]
    for rows in (500, 2_000):
        texts = [" ".join([*(f"own{r}x{k}" for k in range(30)), *passage, *(f"end{r}x{k}" for k in range(30))]) for r in range(rows)]
        docs = spark.createDataFrame([*enumerate(texts), (rows, texts[0] + " more")], "doc_id long, text string")
        found = by_id(jaccard.similarity_classes(docs))
        assert {d for d, r in found.items() if r["n_links"]} == {0, rows} and found[rows]["class_id"] == 0
        keys = jaccard.band_keys(np.stack([jaccard.minhash(s) for s in jaccard.gram_sets(pa.array(texts), 5)]))
        pairs = sum(n * (n - 1) // 2 for n in Counter(keys.ravel().tolist()).values())
        with capsys.disabled():
            print(f"\n{rows} texts: {pairs} pairs compared by sketches of {rows * (rows - 1) // 2}")
        assert pairs < 0.03 * rows * (rows - 1) / 2


def test_pairs_of_blocks():
    sizes = np.array([1, 4, 5, 2])
    sides = np.array([0, 0, 0, 0, 0, 1, 1, 2, 2, 2, 1, 1])
    pairs = {p for i, j in jaccard.pairs_of_blocks(np.array([0, 1, 5, 10]), sizes, sides) for p in zip(i.tolist(), j.tolist())}
    assert pairs == {(a, b) for a in range(1, 5) for b in range(a + 1, 5)} | {(a, b) for a in (5, 6) for b in (7, 8, 9)}


def test_components_with_a_heavy_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HEAVY", 20)
    edges = [(5, k) for k in range(1_000, 1_300)] + [(2_000, 1_100), (2_000, 2_001), (1, 2), (2, 3)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{n: 5 for n in (5, 2_000, 2_001, *range(1_000, 1_300))}, 1: 1, 2: 1, 3: 1}
