"""Whole queries against plain versions of them, and held-out quality, on the driver's tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from talkframe.llm import lang_id, line_dedup, queries, secret_scan, toxicity
from talkframe.llm.common import table

from .test_brute import plain_contamination, plain_match, plain_shingles, texts


def test_op2_as_computed_at_once(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text", "lang").toPandas()
    encoder = lang_id.Encoder()
    vectors, has = encoder.encode(docs.text.fillna("").tolist())
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1).to_numpy()
    langs = sorted(docs.lang.dropna().unique())
    prototypes = np.stack([vectors[~held & (docs.lang == x).to_numpy()].sum(axis=0) for x in langs])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    cosines = vectors @ prototypes.T
    want = {i: (langs[c.argmax()] if h else "und", max(0.0, float(c.max())) if h else 0.0) for i, c, h in zip(docs.doc_id, cosines, has)}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.QUERIES["op2_language_id"](spark, small).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-4 for i in want)


def plain_lines(docs, min_docs=3, min_words=6, similarity=0.75) -> dict:
    """Each document's lines, and which of them go."""
    said, leaves, lines, first, rows = {}, collections.Counter(), collections.Counter(), {}, collections.defaultdict(set)
    for row, (doc, text) in enumerate(docs):
        said[doc] = []
        for line in (text or "").encode().split(b"\n"):
            words = [b"#" if re.search(rb"[0-9]", w) else w for w in re.split(rb"[\x09-\x0d\x20]+", line.lower()) if w]
            counts = len(words) >= min_words and 2 * sum(w != b"#" for w in words) >= len(words)
            said[doc].append((line, tuple(words) if counts else None))
        own = {w for _, w in said[doc] if w}
        leaves.update({(len(w), w[:3]) for w in own})
        lines.update(own)
        for w in own:
            first[w] = min(first.get(w, doc), doc)
            rows[w].add(row)
    by_leaf = collections.defaultdict(list)
    for w in lines:
        if leaves[len(w), w[:3]] >= (2 if len(w) >= 50 else min_docs):
            by_leaf[len(w), w[:3]].append(w)
    place = lambda w: int(line_dedup.Lines.of([b" ".join(x if x != b"#" else b"0" for x in w)], min_words).line.view(np.int64)[0])
    gone = {}
    for (n, _), own in by_leaf.items():
        templates = []
        for w in sorted(own, key=lambda w: (-lines[w], place(w))):
            near = next((t for t in templates if sum(a != b for a, b in zip(t[0], w)) <= int((1 - similarity) * n + 1e-9)), None)
            if near is None:
                templates.append(near := [])
            near.append(w)
        for t in templates:
            if len(set().union(*(rows[w] for w in t))) >= (2 if n >= 50 else min_docs):
                gone |= dict.fromkeys(t, min(first[w] for w in t))
    return {doc: [(line, w in gone and gone[w] != doc) for line, w in own] for doc, own in said.items()}


def test_long_passages_recur_from_two_documents_on(spark):
    passage = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i % 3] * (i // 26)}" for i in range(55))
    short = " ".join(passage.split()[:40])
    rows = [(1, f"{passage}\n{short}\nfirst own line of this one text"), (2, f"an own line of the second text here\n{passage}\n{short}")]
    got = {r["doc_id"]: r["_kept"]["text"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"an own line of the second text here\n{short}"}


@pytest.mark.parametrize("min_docs", [3, 5])
def test_a_document_counts_once_for_all_its_variants(spark, min_docs):
    said = lambda *x: "\n".join(f"Please read our terms before you go {a} the {b} page" for a, b in x)
    rows = [(1, said(("to", "first"), ("on", "second"), ("to", "third"))), (2, said(("at", "first"))), (3, "Please read our other long list of unrelated rules here at once")]
    out = lambda docs: {r["doc_id"]: r["_kept"]["dropped"] for r in line_dedup.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_docs).collect()}
    assert out(rows[:2]) == {1: 0, 2: 0} and out(rows) == {1: 0, 2: 0, 3: 0}
    more = rows + [(i, said(("by", f"{'abcdefgh'[i]}th"))) for i in range(4, 2 + min_docs)]
    assert out(more) == {1: 0, 3: 0} | {i: 1 for i, _ in more if i not in (1, 3)}
    rng = random.Random(min_docs)
    words = lambda: " ".join(["we", "keep", "your", *(rng.choice("ab") for _ in range(7))])
    crowd = [(i, "\n".join(words() for _ in range(rng.randint(1, 4)))) for i in range(40)]
    assert out(crowd) == {i: sum(drop for _, drop in own) for i, own in plain_lines(crowd, min_docs).items()}


def test_op6(spark, small):
    want = {}
    for doc, own in plain_lines(texts(spark, small)).items():
        lost = [x for x, drop in own if drop]
        if lost:
            kept = b"\n".join(x for x, drop in own if not drop)
            want[doc] = (len(own), len(lost), sum(map(len, lost)), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["dropped_bytes"], r["kept_sha256"]) for r in queries.QUERIES["op6_line_dedup"](spark, small).collect()}
    assert got == want and len(want) > 20


PATTERNS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)


def test_op7(spark, small):
    docs = texts(spark, small) + [(10_001, "note: pwd is Zq7#kWm2!xPv and ok"), (10_002, "pwd: password-admin1")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    counts = collections.Counter()
    for _, t in docs:
        spans = sorted(m.span(1) for p in (secret_scan.CONTEXT, secret_scan.ASSIGN) for m in p.finditer(t or ""))
        keep, at = [], 0
        for a, b in spans:
            keep.append((t or "")[at : max(at, a)])
            at = max(at, b)
        counts.update(set(re.findall(r"[^\W\d_]{3,24}", " ".join([*keep, (t or "")[at:]]).lower())))
    known = {w: n for w, n in counts.items() if n >= secret_scan.SEEN and w not in secret_scan.RANKS}
    ranks = secret_scan.RANKS | {w: len(secret_scan.COMMON) + 1 + sum(m > n for m in known.values()) for w, n in known.items()}
    want = {}
    for i, t in docs:
        base = [(m.start(), k, kind, m.end()) for k, (kind, p, least) in enumerate(PATTERNS) for m in re.finditer(p, t or "") if len(m[1]) >= least]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(base))
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.find_secrets(t, ranks=ranks))
        want[i] = (*(sum(x[2] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest(), spans)
    found = {r["doc_id"]: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["secrets"]) for r in secret_scan.scan(rows).collect()}
    assert found == {i: x[-1] for i, x in want.items()} and "guess" in found[10_001] and found[10_002] == ""
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_secret_scan"](spark, small).collect()}
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want[i][:4] for i, r in got.items()) and len(got) == len(docs) - 2


def test_op7_values_of_any_length(spark):
    """Values of thousands and of a million letters: random ones are secrets, those of known words are judged by them."""
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABC", k=n))
    known = ["orchard", "lantern", "winterly", "Ostrich", "fox"]
    rows = [(i, f"the {' '.join(known)} sentence") for i in range(3)]
    rows += [(3, f"pwd: {letters(10_000)}"), (4, f"pwd: {letters(1_000_000)} and more"), (5, "pwd: orchardlantern9"), (6, f"pwd: {'z' * 20_000}"), (7, f"pwd: {letters(200)}é{letters(200)}0rch4rd")]
    got = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ranks = secret_scan.RANKS | {w.lower(): len(secret_scan.COMMON) + 1 for w in [*known, "the", "sentence"] if w not in secret_scan.RANKS}
    assert got == {i: secret_scan.find_secrets(t, ranks=ranks) for i, t in rows}
    assert got[3] == [("guess", 5, 10_005)] and got[4] == [("guess", 5, 1_000_005)] and got[5] == [] and got[6] == [] and len(got[7]) == 1
    value = rows[7][1][5:]
    every = {value.lower().translate(table)[i:j] for table in ({}, secret_scan.LEET) for i in range(len(value)) for j in range(i + 3, min(len(value), i + 24) + 1)}
    every = {w for w in every if w.isalpha()}
    assert set(secret_scan.heads_of(value, {w[:4] for w in every})) == every


class PlainTrie:
    """The lexicon without automata."""

    def __init__(self, model) -> None:
        self.terms, self.prefixes = model.terms, model.prefixes
        self.weight = {**model.terms, **{f"{p}*": w for p, w in model.prefixes.items()}}

    def match(self, word):
        return plain_match(word, self.terms, self.prefixes)


def test_op9_scores(spark, small):
    docs, labels = table(spark, small, "documents").select("doc_id", "text"), table(spark, small, "labels")
    held = {i for i, _ in texts(spark, small) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = toxicity.fit(docs, labels.where(~labels.doc_id.isin(*held)))
    trie, memo = PlainTrie(model), {}
    want = {i: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(toxicity.features(t or "", trie, memo), model.weights)))))) for i, t in texts(spark, small)}
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity"](spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["score"] - want[i]) < 1e-9 and got[i]["held_out"] == (i in held) and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i in want)


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect() if r["toxic"] is not None}
    rows = [(r["score"], r["predicted"], toxic[r["doc_id"]]) for r in queries.QUERIES["op9_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, good = ([s for s, _, t in rows if t == k] for k in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    assert wins > 0.95 and sum(p == t for _, p, t in rows) > 0.9 * len(rows)


def test_pipeline(spark, small):
    """Every stage by hand, each on what the one before it leaves."""
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = table(spark, small, "documents").select("doc_id", "text", "lang").toPandas()
    vectors, has = lang_id.Encoder().encode(rows.text.fillna("").tolist())
    langs = sorted(rows.lang.dropna().unique())
    prototypes = np.stack([vectors[(rows.lang == x).to_numpy()].sum(axis=0) for x in langs])
    best = (vectors @ (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).T).max(axis=1)
    few = rows.text.fillna("").map(lambda t: sum(c.isalpha() for c in t) < corpus_pipeline.LEAST_LETTERS).to_numpy()
    docs = [(i, t) for i, t, h, b, f in zip(rows.doc_id, rows.text, has, best, few) if h and (b >= corpus_pipeline.LEAST_COSINE or f)]

    kept = plain_lines(docs)
    docs = [(i, b"\n".join(x for x, drop in kept[i] if not drop).decode()) for i, _ in docs]

    sets = {i: plain_shingles(t) for i, t in docs}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = [(i, t) for i, t in docs if find(i) == i]

    items = table(spark, small, "benchmark").select("item_id", "text").collect()
    bad = {i for i, _ in plain_contamination(docs, items)}
    docs = [(i, t) for i, t in docs if i not in bad]

    plain = Tokenizer.from_file(path)
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in docs}
    got = corpus_pipeline.run(spark, small).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert got.groupby("sequence_id").length.sum().max() <= 2048 and bad and len(want) < len(rows)


def test_language_stage_rejects_what_it_has_not_learned(spark, small):
    """Long texts of random letters and of scripts without a prototype go; short ones and learned ones stay."""
    rng = random.Random(1)
    scripts = ("abcdefghijklmnopqrstuvwxyz     ", "αβγδεζηθικλμνξοπ   ", "".join(map(chr, range(0x4E00, 0x4F00))))
    odd = [(100_000 + 10 * k + i, "".join(rng.choices(s, k=600)), None) for k, s in enumerate(scripts) for i in range(10)]
    short = [(200_000 + k, s[:9], None) for k, s in enumerate(scripts)]
    docs = table(spark, small, "documents").select("doc_id", "text", "lang")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionAll(spark.createDataFrame(odd + short, docs.schema)), small).collect()}
    own = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {i for i, *_ in short} <= kept and not {i for i, *_ in odd} & kept and own <= kept
