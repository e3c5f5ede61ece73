"""Scans, token counts, packing, chat formatting and toxicity against plain Python and the tokenizers themselves."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from winnow.llm import chat, grouping, licenses, packing, pipeline, pretokens, secrets, textcnn, textscan, token_counts, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark, brute.awkward())


def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


# Words and pre-tokens

TEXTS = st.lists(st.text(st.sampled_from("abT é日'.<|endoftext>\n\t 12—“ñ s"), max_size=40), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for table, pattern in ((textscan.ALPHANUMERIC, brute.WORD), (textscan.BLANK_SEPARATED, re.compile(r"[^\x20\x09-\x0D]+"))):
        words = textscan.Words(pa.array(texts), table)
        got = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)]
        want = [brute.lowered(w) for w in got]
        assert want == [w for t in texts for w in pattern.findall(brute.lowered(t))]
        assert [len({h for h, w in zip(words.hashes().tolist(), want, strict=True) if w == x}) for x in set(want)] == [1] * len(set(want))


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_pretokens_encode_as_the_library_does(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = pretokens.cache(public_tokenizers.path(name), spaced)
        ids, at = pretokens.encode_texts(texts, own)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == own.encode(texts)


def test_the_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(pretokens, "MAX_CACHED", 8)
    own = pretokens.Cache(public_tokenizers.path("byte_bpe_50k.json"), True)
    for texts in (["a b c d e f"], ["g h i j k l m"], ["a b c"]):
        ids, _ = pretokens.encode_texts(texts, own)
        assert ids.tolist() == own.encode(texts)[0]


def test_token_counts(spark, docs):
    library = tokenizer("byte_bpe_50k.json")
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in brute.awkward())
    rows = token_counts.count(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert token_counts.count(docs.limit(0)).count() == 0
    plan = token_counts.count(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_table_of_frequent_pretokens_holds_the_librarys_lengths():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = token_counts.frequent_pretokens(path)
    assert len(words) > 40_000 and {" the", "The", "\n"} <= set(words)
    own = pretokens.cache(path, True)
    some = words[::97]
    assert own.encode_words(some)[1].tolist() == [len(x) for x in own.encode(some)]
    hashes = np.concatenate([pretokens.Split([w], True).hashes() for w in some])
    table = token_counts.Table(hashes, own.encode_words(some)[1])
    assert table.get(np.append(hashes, hashes[:1] + np.uint64(1))).tolist() == [*own.encode_words(some)[1].tolist(), -1]


# Packing


def _check_packing(rows, texts):
    library = tokenizer("word_bpe_49k.json")
    want = Counter()
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(-(-len(ids) // 2048)):
            cut = ids[p * 2048 : (p + 1) * 2048]
            want[i, p, p * 2048, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs.repartition(3)).collect()
    n = _check_packing(rows, brute.awkward())
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=40))
def test_bins_hold_every_length_once(counts):
    lengths, n = np.array(sorted(counts), np.int64), np.array([counts[k] for k in sorted(counts)], np.int64)
    bins = grouping.pack(lengths, n, 100)
    held = Counter()
    for b in bins:
        assert b.count > 0 and sum(a * k for a, k in b.items) <= 100
        for a, k in b.items:
            held[a] += k * b.count
    assert held == Counter(counts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.floats(0, 1), min_size=1, max_size=8), st.integers(60, 150))
def test_best_configuration_is_the_best(worth, capacity):
    sizes = sorted(worth, reverse=True)
    values = np.array([worth[s] for s in sizes])
    got, taken = grouping._best_configuration(sizes, values, capacity)
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1], *(best[c - s] + worth[s] for s in sizes if s <= c)])
    assert abs(got - best[capacity]) < 1e-4 and abs(taken @ values - got) < 1e-9 and taken @ np.array(sizes) <= capacity


def test_every_setting_is_tried_at_every_size():
    """Also where the first comes near to the bound, as with many lengths that vary much."""
    rng = np.random.default_rng(2)
    for draw in (rng.lognormal(3, 1.2, 40_000), rng.normal(50, 6, 40_000)):
        lengths, counts = np.unique(np.clip(draw.astype(np.int64), 1, 128), return_counts=True)
        bins = sum(b.count for b in grouping.pack(lengths, counts, 128))
        assert bins == min(sum(b.count for b in grouping._grouped(lengths, counts, 128, s)) for s in grouping.SMALL)


def test_bins_of_usual_lengths_are_few():
    """Against the volume's bound and best-fit decreasing, on lengths as texts have them."""
    rng = np.random.default_rng(1)
    for capacity, draw in ((2048, rng.lognormal(5.5, 1, 30_000)), (128, rng.uniform(30, 90, 3000)), (128, rng.normal(50, 6, 3000))):
        lengths, counts = np.unique(np.clip(draw.astype(np.int64), 1, capacity), return_counts=True)
        bins = sum(b.count for b in grouping.pack(lengths, counts, capacity))
        free = grouping._Free(capacity)
        for a, k in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
            free.place(a, k)
        assert bins <= 1.01 * sum(b.count for b in free.all())


# Scans


def test_trigram_queries_miss_nothing(spark, docs):
    texts = [t for _, t in brute.awkward()] + ["x-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, 'API_KEY:"abcdefghijkl"', "token=short secret = 'aaaaaaaaaaaaaaa'"]
    found = secrets.find(pa.array(texts, pa.string()))
    for t, spans in zip(texts, found, strict=True):
        want = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t or "") if m.end(r.group) - m.start(r.group) >= r.least]
        assert spans == sorted(want)
    assert secrets.trigram_query("a[0-9]+") is None and secrets.trigram_query("abc|abd") == ("or", (b"abc", b"abd"))
    row = secrets.report(docs).where("doc_id = 13").first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1) and row.spans.startswith("access:0:22,assign:23:")
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    masked = secrets.mask(docs).where("doc_id = 13").first()
    assert masked.text == "[SECRET] [SECRET] [SECRET]" and secrets.report(docs.limit(0)).count() == 0


BASE = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def _base_spans(text):
    """The base spans by the contract's own patterns."""
    out = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (p, g, least)) in enumerate(BASE.items()) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(kind.split(":")[0], kind) for _, _, kind in sorted(out)]


def test_base_secrets_are_those_of_the_contract(spark):
    rng = np.random.default_rng(12)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "'", '"', " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", "é", "\n", "x", "abc.def/ghi+jkl=", "G"]
    texts = [(100 + i, "".join(rng.choice(parts, rng.integers(1, 40)))) for i in range(400)]
    got = {r.doc_id: r for r in secrets.report(brute.documents(spark, texts)).collect()}
    for i, t in texts:
        spans = _base_spans(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(kind == k for kind, _ in spans) for k in BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for _, s in spans).encode()).hexdigest()
    assert sum(len(_base_spans(t)) for _, t in texts) > 300


def test_many_openings_of_a_token_in_one_run_are_read_once():
    text = "eyJ" * 200_000
    began = time.perf_counter()
    assert secrets.find(pa.array([text])) == [[]] and time.perf_counter() - began < 5
    real = "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12
    kinds = [[(a, secrets.RULES[k].kind, b) for a, k, b in x if secrets.RULES[k].kind == "jwt"] for x in secrets.find(pa.array([f"x eyJab.{real} eyJ", f"zeyJ{real}"]))]
    assert kinds == [[(2 + 6, "jwt", 2 + 6 + len(real))], [(1, "jwt", 4 + len(real))]]


@pytest.mark.parametrize("pattern", ["(ab|cd)ef+g", "x?yzw", "[ab]bc[de]", "(foo){2}", "q(?:uu|vv)*rst", "日本語", "a.cde"])
def test_trigram_queries_hold_for_matches(pattern):
    query, samples = secrets.trigram_query(pattern), ["abefg", "cdeffg", "yzw", "xyzw", "bbcd", "foofoo", "qrst", "quuvvrst", "日本語", "abcde"]
    holds = lambda q, t: q is None or (q in t.encode() if isinstance(q, bytes) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1]))
    assert any(re.fullmatch(pattern, s) for s in samples)
    assert all(holds(query, s) for s in samples if re.search(pattern, s))


def test_license_places(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the..."
    texts = brute.awkward() + [(30, notice), (31, "under the MIT license under-the-mit LICENSE"), (32, "cc by"), (33, "nc cc by nc. CC BY NC")]
    got = licenses.scan(brute.documents(spark, texts)).collect()
    want = []
    for i, t in texts:
        words, starts, labels = brute.WORD.findall(brute.lowered(t)), [], set()
        for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
            p = phrase.split()
            places = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            starts += places
            labels |= {label} if places else set()
        want.append((str(i), len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert {r.doc_id: (r.labels, r.score) for r in got}[30] == ("mit-grant", 1.0)
    assert licenses.scan(brute.documents(spark, [])).count() == 0


def test_key_phrases_are_found_without_the_rest_of_their_templates(spark):
    """Each key phrase alone, and with the template's words around it, in a corpus that lacks most licence words."""
    keys = {t.label: " ".join(t.words[slice(*t.key)]) for t in licenses.TEMPLATES}
    for label, key in keys.items():
        texts = [(1, f"some words {key} and more"), (2, key.upper()), (3, key), (4, key.rsplit(" ", 1)[0]), (5, f"{key} {key}")]
        got = {r.doc_id: label in r.labels.split(",") for r in licenses.scan(brute.documents(spark, texts)).collect()}
        assert got == {1: True, 2: True, 3: True, 4: False, 5: True}


def _all_of(text, templates):
    """Labels and score by looking at every word position."""
    words, labels, score = brute.WORD.findall(brute.lowered(text)), set(), 0.0
    for t in templates:
        low, high = t.key
        for i in range(len(words) - (high - low) + 1):
            if tuple(words[i : i + high - low]) == t.words[low:high]:
                labels.add(t.label)
                around = [0 <= i - low + k < len(words) and words[i - low + k] == w for k, w in enumerate(t.words)]
                score = max(score, sum(around) / len(around))
    return ",".join(sorted(labels)), score


def test_license_labels_are_those_of_every_position(spark):
    rng = np.random.default_rng(21)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.words})
    texts = list(brute.awkward())
    for i in range(150):
        words: list[str] = []
        for _ in range(rng.integers(1, 5)):
            t = licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))]
            low, high = (0, len(t.words)) if rng.random() < 0.4 else (max(0, t.key[0] - int(rng.integers(3))), t.key[1] + int(rng.integers(-1, 3)))
            own = list(t.words[low:high])
            if rng.random() < 0.3:
                own[rng.integers(len(own))] = "other"
            words += [*rng.choice(vocabulary, rng.integers(0, 6)), *own]
        texts.append((1000 + i, ", ".join(words)))
    rows = licenses.scan(brute.documents(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.labels, r.score) for r in rows) == sorted((str(i), *_all_of(t, licenses.TEMPLATES)) for i, t in texts)
    assert len({r.labels for r in rows}) > 50


def test_lookups_are_each_files_rarest_words_and_enough_for_every_phrase():
    index = licenses.Index(licenses.TEMPLATES, {w: 1 / (1 + i) for i, w in enumerate(sorted({w for t in licenses.TEMPLATES for w in t.words}))})
    every = np.arange(len(index.order))
    chosen, possible = index.lookups(np.concatenate([every, every[:5]]), np.repeat([0, 1], [len(every), 5]), 3)
    assert possible[0].all() and not possible[1:].any() and not chosen[1:].any()
    assert chosen[0, index.order[: licenses.LOOKUPS]].all() and ((index.holds > 0) & chosen[0]).any(axis=1).all()


# Chat


def test_chat_round_trip(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", probe), (1, 1, "assistant", probe), (2, 1, "us\ner\\n", "a\\|b<|im_end|>\\n\n"), (2, 1, None, None), (2, 2, "assistant", "é\\<|"), (None, 1, "assistant", "x"), (3, None, "assistant", ""), (3, None, "assistant", "")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " * 50) for i in range(3000)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat.report(turns).collect()}
    texts = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert set(got) == set(by) == set(texts)
    for conv, held in by.items():
        held.sort()
        all_turns = "".join(f"{role}\n{text}\n" for _, _, role, text in held)
        loss = "".join(text for _, _, role, text in held if role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(held), hashlib.sha256(all_turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == len(texts[conv].formatted)
        data = texts[conv].formatted.encode()
        assert b"".join(chat.unescape(data[s.start : s.end]) for s in texts[conv].loss).decode() == loss
    assert chat.report(turns.limit(0)).count() == 0 and chat.format_conversations(turns.limit(0)).count() == 0


def test_strings_lie_over_the_assembled_buffer():
    built = chat.assemble(pa.array(["user", None, "assistant"]), pa.array(["a", "b|", "<|é"]))
    texts = chat.strings(built, [(1, 0, 2), (2, 2, 3)])
    assert texts.to_pylist() == ["<|im_start|>user\na<|im_end|>\n<|im_start|>\nb|<|im_end|>\n", "<|im_start|>assistant\n<\\|é<|im_end|>\n"]
    assert texts.buffers()[2].address == built.data.ctypes.data
    masks = chat.masks(built, [(1, 0, 2), (2, 2, 3)]).to_pylist()
    assert masks == [[], [{"start": 22, "end": 27}]]


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    """Invented insults mark some texts; the rest are clean. Labels of held-out rows aren't learned from."""
    rng = np.random.default_rng(3)
    plain, bad = [f"plain{i}" for i in range(400)], ["zorble", "grumpt", "vexin"]
    texts, labels = [], []
    for i in range(1000, 1900):
        words = list(rng.choice(plain, 60))
        toxic = i % 4 == 0
        if toxic:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(0, 60)), str(w))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = brute.documents(spark, texts + brute.awkward()[-4:])
    table = spark.createDataFrame([*labels, (None, 1, 1), (1005, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.report(docs, table).collect()}
    held = [i for i, _, _ in labels if rows[i].held_out]
    assert held == [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [rows[i].predicted == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    kept = toxicity.keep_clean(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())
    assert kept.where("score = 0.5").count() == kept.count()


def test_scores_follow_an_independent_forward_pass():
    """Logits of whole blocks against one text at a time, window by window."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(1, 1 << textcnn.BUCKET_BITS, (n, 3)) for n in (40, 1, 7, 5000)] * 3
    model = textcnn.train(texts, np.array([0, 1, 0, 1] * 3))
    for cut in ([*texts[:4], np.zeros((0, 3), np.int64)], [texts[3]]):
        got = model.logits(np.concatenate(cut), np.concatenate([[0], np.cumsum([len(t) for t in cut])]))
        for z, t in zip(got, cut, strict=True):
            x = np.array([sum(model.embedding[model.row[b]] for b in w) for w in t] or [np.zeros(textcnn.DIM)])
            pooled = []
            for width, w, b in zip(textcnn.WIDTHS, model.filters, model.bias, strict=True):
                full = np.concatenate([x, np.zeros((width - 1, textcnn.DIM))])
                pooled.append(np.maximum(np.max([full[i : i + width].ravel() @ w + b for i in range(len(x))], axis=0), 0))
            assert abs(z - (np.concatenate(pooled) @ model.weight + model.offset)) < 1e-3


def test_long_texts_are_learned_from_as_they_are_scored():
    """Windows see the same neighbours: a long text keeps the places of its unknown words."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(1, 1 << textcnn.BUCKET_BITS, (n, 3)) for n in (5000, 4500, 30, 30)] * 2
    seen = []
    forward = textcnn._forward
    textcnn._forward = lambda model, ids: seen.append(len(ids)) or forward(model, ids)
    try:
        textcnn.train(texts, np.array([1, 0] * 4))
    finally:
        textcnn._forward = forward
    assert set(seen) == {5000, 4500, 30}


def test_a_fitted_model_scores_awkward_rows(spark, docs, monkeypatch):
    words = [f"plain{i}" for i in range(50)]
    rng = np.random.default_rng(2)
    texts = [(i, " ".join([*rng.choice(words, 30), *(["zorble"] * (i % 2))])) for i in range(2000, 2200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    known = brute.documents(spark, texts + texts[:40])
    model = toxicity.fit(known, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == len(brute.awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1  # null, empty and blank alike
    for text in {r.text for r in rows}:
        assert len({r.score for r in rows if r.text == text}) == 1
    with pytest.raises(ValueError, match="other names"):
        toxicity.score(docs, model)
    sample, toxic, share = toxicity.labelled_sample(known, labels, 3000)
    assert len(sample) == len(toxic) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in texts) and 0.4 < share < 0.6
    monkeypatch.setattr(toxicity, "MAX_WORDS", 100)
    assert [len(t) for t, y in zip(*toxicity.labelled_sample(known, labels, 3000)[:2], strict=True) if y == 0] == [30, 30, 30]


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Whatever the bounds of samples; shares of rows give one classifier, however the rows lie in partitions and repeat."""
    rng = np.random.default_rng(4)
    plain, bad = [f"plain{i}" for i in range(200)], [f"{a}{b}" for a in ("zorble", "grumpt", "vexin", "quaffle") for b in "abcde"]
    texts = [(i, " ".join([*rng.choice(plain, 20), *(rng.choice(bad, 2) if i % 2 else [])])) for i in range(900)]
    docs, labels = brute.documents(spark, texts), spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    learned = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 != 0]
    monkeypatch.setattr(toxicity, "MAX_WORDS", 100)
    monkeypatch.setattr(toxicity, "SHARE_ROWS", 150, raising=False)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).collect()
    held = [r for r in rows if r.doc_id not in set(learned)]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    known = toxicity.learnable(labels)
    features = toxicity.labelled_features(docs.union(docs).repartition(3), known, len(learned))
    assert features.count() == len(learned) and 0.15 < features.where("calibrates").count() / len(learned) < 0.35
    assert len(features.inputFiles()) == 4
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 10)  # labels come by a join
    again = toxicity.fit(docs.union(docs).repartition(3), labels)
    assert again.threshold == model.threshold and (again.embedding == model.embedding).all() and (again.weight == model.weight).all()


def test_the_pipeline_learns_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """Its first stage has no bound on words either: each insult stands in a few texts alone."""
    rng = np.random.default_rng(6)
    plain, bad = [f"plain{i}" for i in range(100)], [f"zorble{i}" for i in range(12)]
    texts = [(i, " ".join([*rng.choice(plain, 12), *([bad[i // 2 % 12]] if i % 2 else [])])) for i in range(500)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "MAX_WORDS", 30)
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, brute.documents(spark, texts), tmp_path.as_uri()).select("doc_id").collect()}
    assert np.mean([(i in kept) == (i % 2 == 0) for i, _ in texts]) > 0.95


def test_dense_parts_travel_whole():
    model, sums = textcnn.start(np.arange(1 << textcnn.BUCKET_BITS) == 5, np.random.default_rng(1))
    values = np.random.default_rng(2).random(len(textcnn.dense_of(model, sums))).astype(np.float32).astype(np.float64)
    textcnn.set_dense(model, sums, values)
    assert (textcnn.dense_of(model, sums) == values).all() and model.offset in values and sums.offset == values[-1]


def test_without_labels_nothing_is_toxic(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(docs, none).count() == docs.count()
    assert toxicity.report(docs.limit(0), none).count() == 0
