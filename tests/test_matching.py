"""Similar words, sounds and references by joins against comparing everything."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from talkframe.functions.similarity import SHARED_BESIDES, jaro_winkler_of, metaphone_of, similarity_keys
from talkframe.operators import matching as ma


def words_of(rng: random.Random, n: int, letters: str = "abcde", most: int = 12) -> list[str]:
    out = ["".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(n // 2)]
    for w in list(out):  # and words near to these
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 2))
            w = w or ["a"]
        out.append("".join(w))
    return out


@pytest.mark.parametrize("least", [0.6, 0.75, 0.82, 0.85, 0.95])
def test_similar_words_share_a_key(least):
    rng = random.Random(int(least * 100))
    for letters in ("abc", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz"):
        left, right = words_of(rng, 80, letters), words_of(rng, 80, letters)
        right += left[:5]
        lengths = [tuple({len(w) for w in side}) for side in (left, right)]
        near = [(a, b) for a in left for b in right if jaro_winkler_of(a, b) >= least]
        for besides in SHARED_BESIDES.values():
            keys = {w: similarity_keys(w, lengths[1], least, True, besides) for w in left}
            others = {w: similarity_keys(w, lengths[0], least, False, besides) for w in right}
            assert not [(a, b) for a, b in near if not keys[a] & others[b]]


def test_fewer_pairs_than_all():
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinsrhldcumfpgwybvkxjqz", k=rng.randint(8, 14))) for _ in range(400)]
    lengths = tuple({len(w) for w in words})
    keys, others = ([similarity_keys(w, lengths, 0.85, first) for w in words] for first in (True, False))
    met = sum(bool(a & b) for a in keys for b in others)
    assert met < 0.1 * len(words) ** 2


def test_best_names_and_folders_as_if_all_were_compared(spark):
    rng = random.Random(2)
    rows = [(u, w) for u in "xy" for w in words_of(rng, 80, "abcdefgh")]
    tokens, names = rows[::2], [(u, w.capitalize(), i) for i, (u, w) in enumerate(rows[1::2])]
    got = ma.best_match(spark.createDataFrame(tokens, "u string, token string"), spark.createDataFrame(names, "u string, name string, ord int"), by=["u"])
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for u, t in set(tokens):
        score, _, name = min((-jaro_winkler_of(t.lower(), n.lower()), i, n) for v, n, i in names if v == u)
        if -score >= ma.SIMILAR:
            want[u, t] = (name, round(-score, 9))
    assert {(r["u"], r["token"]): (r["name"], round(r["score"], 9)) for r in got.collect()} == want and want
    got = ma.best_folder(spark.createDataFrame(tokens, "u string, token string"), spark.createDataFrame([(u, n.lower()) for u, n, _ in names], "u string, name string"), by=["u"])
    want = {}
    for u, t in {x for x in tokens if len(x[1]) >= 4}:
        score, name = min((-ma.folder_score(t, n.lower()), n.lower()) for v, n, _ in names if v == u)
        if -score >= ma.SIMILAR_FOLDER:
            want[u, t] = (name, round(-score, 9))
    assert {(r["u"], r["token"]): (r["name"], round(r["score"], 9)) for r in got.collect()} == want and want


LONG = "AlphaBetaGammaDeltaEpsilonZetaEta"
SYMBOLS = [
    ("a", 1, "PasteService", "class", "a.py", 1), ("a", 2, "RecordingService", "class", "b.py", 2), ("a", 3, "Auth", "module", "c.py", 3), ("b", 4, "PasteService", "func", "z.py", 9), ("b", 5, "PasteService", "class", "y.py", 8),
    ("b", 6, LONG, "class", "l.py", 4), ("b", 7, "BetaGamma", "func", "m.py", 5), ("a", 8, "PasteServices", "func", "q.py", 6), ("b", 9, "UserRepositoryService", "struct", "u.py", 7), ("a", 10, "UserService", "class", "v.py", 2),
]
SYMBOL_DDL = "user_id string, id long, symbol_name string, symbol_type string, file_path string, line_number int"
FOLDERS = [("a", "widgets", "ui/widgets/"), ("a", "widgets", "lib/widgets/"), ("b", "gadget", "ui/gadget/"), ("a", "recorder", "rec/")]


def parts_of(name: str) -> list[str]:
    import re

    return [p.lower() for p in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+", name)]


def code(word: str) -> str:
    return metaphone_of(word) or word


def plain_sounds(clean: list[str], symbols: list[tuple]) -> list[tuple]:
    """start, n and symbol of every run that sounds like a symbol's parts."""
    import re

    said = [code(re.sub("'[a-zA-ZığüşöçİĞÜŞÖÇ]+$", "", w).lower()) if w else None for w in clean]
    out = []
    for s in symbols:
        want = [code(p) for p in parts_of(s[2])]
        for i in range(len(clean) - len(want) + 1) if len(want) > 1 else ():
            if all(x and jaro_winkler_of(x, p) >= ma.SIMILAR for x, p in zip(said[i:], want)):
                out.append((i, len(want), s))
    return out


def plain_injection(user: str, text: str, gated: bool) -> str:
    """What each word may stand for by looking at all symbols and folders."""
    import re

    spoken = text.split()
    clean = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in spoken]
    own = [s for s in SYMBOLS if s[0] == user]
    shape = lambda s: {"symbol_name": s[2], "place": f"@{s[4]}:{s[5]} {s[2]}", "plain": s[3] == "module" and len(parts_of(s[2])) < 2}
    names = {}
    for w in clean:
        if re.match(r"[A-Z][a-zA-Z0-9]{2,}\Z", w):
            exact = sorted((s for s in own if s[2].lower() == w.lower()), key=lambda s: ({"class": 0, "struct": 1}.get(s[3], 2), s[1]))
            near = sorted((-jaro_winkler_of(w.lower(), s[2].lower()), s[1], s) for s in own)
            names[w] = {"exact": shape(exact[0]) if exact else None, "ranked": [shape(s) for x, _, s in near if -x >= ma.SIMILAR]}
    size = {}
    for s in own:
        size.setdefault(len(parts_of(s[2])), s[1])
    heard = sorted(plain_sounds(clean, own), key=lambda x: (x[0], size[x[1]], x[2][1]))
    folders = {}
    for i in range(len(clean)):
        for n in (1, 2):
            token = "".join(clean[i : i + n]).lower()
            near = sorted((-ma.folder_score(token, f), f) for u, f, _ in FOLDERS if u == user)
            if len(token) >= 4 and near and -near[0][0] >= ma.SIMILAR_FOLDER:
                folders[token] = {"name": near[0][1], "paths": sorted({p for u, f, p in FOLDERS if (u, f) == (user, near[0][1])})}
    return ma.placed(spoken, clean, names, [{"start": i, "n": n, **shape(s)} for i, n, s in heard], folders, gated) or text


SAID = [
    "PasteService, PasteService", "open PasteServise now", "the recording service'i here", "somewhere widgets please", "Auth plain", "say alpha beta gama delta epsilon zeta eta now", "beta gamma and alpha beta",
    "UserService UserServise UserRepositoryServices", "user repository servis and user service", "the wid gets and gad get", "record er Recording", "", "  spaced   out  ", None, "PasteServices pasteservices Pastes",
]


@pytest.mark.parametrize("gated", [False, True])
def test_references_of_each_user(spark, gated):
    rows = [(u, t, i) for i, (t, u) in enumerate((t, u) for t in SAID for u in ("a", "b", "c", None))]
    df = spark.createDataFrame(rows + rows[:3], "user_id string, text string, k int")
    got = ma.inject_symbols(df, spark.createDataFrame(SYMBOLS, SYMBOL_DDL), spark.createDataFrame(FOLDERS, "user_id string, name string, path string"), user="user_id", gated=gated)
    assert got.columns == df.columns
    want = [(u, t if u is None or t is None else plain_injection(u, t, gated), k) for u, t, k in rows + rows[:3]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if not gated:
        said = {(u, SAID[k // 4]): t for u, t, k in want}
        assert said["a", SAID[0]] == "@a.py:1 PasteService PasteService" and said["a", SAID[1]] == "open @q.py:6 PasteServices now" and said["a", SAID[2]] == "the @b.py:2 RecordingService here"
        assert said["a", SAID[3]] == "somewhere @lib/widgets/ @ui/widgets/ please" and said["a", "Auth plain"] == "Auth plain" and said["b", SAID[0]] == "@y.py:8 PasteService PasteService"
        assert said["b", SAID[5]] == f"say @l.py:4 {LONG} now" and said["a", SAID[5]] == SAID[5]


def test_sounds_as_if_all_were_compared(spark):
    rng = random.Random(7)
    vocabulary = ["paste", "service", "recording", "user", "repository", "alpha", "beta", "gama", "gamma", "delta", "servis", "pasta", "x", "'", "kullanıcı", "épsilon", "zeta", "eta", "epsilon"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(60)] + [(99, "alpha beta gamma delta epsilon zeta eta"), (98, None)]
    got = ma.phonetic_matches(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(SYMBOLS, SYMBOL_DDL), "k")
    want = {(k, i, n, s[2]) for k, t in texts for i, n, s in plain_sounds((t or "").split(), SYMBOLS)}
    assert {(r["k"], r["start"], r["n"], r["symbol_name"]) for r in got.collect()} == want and (99, 0, 7, LONG) in want
    none = spark.createDataFrame(SYMBOLS[2:3], SYMBOL_DDL)
    assert ma.phonetic_matches(spark.createDataFrame(texts, "k int, text string"), none, "k").collect() == []
    assert ma.phonetic_matches(spark.createDataFrame(texts, "k int, text string").selectExpr("*", "'a' AS user_id"), none, "k", by=["user_id"]).collect() == []


def test_the_whole_chain_of_many_users_is_one_call_a_user(spark):
    from talkframe.operators.cleaning import clean

    rows = [(u, t, m, i) for i, (u, t, m) in enumerate((u, t, m) for u in ("a", "b", "c") for t in ("my sig.", "Yani PasteServis aç", "the widgets servis", "wide gadget beta gamma") for m in ("engineering", "general", "it_dataset"))]
    df = spark.createDataFrame(rows, "user_id string, text string, mode string, k int")
    entries = spark.createDataFrame([("a", "servis", "service", 1), ("b", "servis", "servant", 2), (None, "aç", "open", 3)], "user_id string, trigger string, replacement string, ord int")
    snippets = spark.createDataFrame([("a", "my sig", "A.", 2), (None, "my sig", "all", 1), ("b", "my sig", "B.", 0)], "user_id string, trigger_phrase string, expansion string, ord int")
    symbols, folders = spark.createDataFrame(SYMBOLS, SYMBOL_DDL), spark.createDataFrame(FOLDERS, "user_id string, name string, path string")
    all_ = {r["k"]: r for r in clean(df, entries, snippets, symbols=symbols, folders=folders).collect()}
    assert len(all_) == len(rows)
    for user in ("a", "b"):
        own = lambda t: t.where(f"user_id = '{user}' OR user_id IS NULL").drop("user_id")  # noqa: E731, B023
        for r in clean(df.where(f"user_id = '{user}'"), own(entries), own(snippets), symbols=own(symbols), folders=own(folders)).collect():
            # Alone, everyone's snippet and the user's own are told apart by ord alone; here too.
            assert r == all_[r["k"]]
    assert all_[1]["text"] == "All" and all_[13]["text"] == "B." and all_[25]["text"] == "All" and all_[2]["text"] == "my sig."
    assert all_[6]["symbol_refs"] == {"widgets": "lib/widgets/"} or set(all_[6]["symbol_refs"].values()) == {"lib/widgets/", "ui/widgets/"}


def test_keys_of_words_are_not_broadcast(spark):
    """Spark judges a side by its words, before each becomes many keys."""
    words = spark.createDataFrame([(w,) for w in words_of(random.Random(8), 60, "abcdefgh", 9)], "a string").selectExpr("a", "a AS b")
    pairs = ma.similar_pairs(words, words, "a", "b", 0.85)
    assert pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_words_of_texts_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Spark judges them by the file that the texts are in, however short it is for them."""
    plans, checkpointed = [], ma.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(ma, "checkpointed", seen)
    spark.range(2000).select(F.col("id").alias("k"), F.lit("the paste servis and more").alias("text")).write.parquet(f"{tmp_path}/texts")
    found = ma.phonetic_matches(spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame([("PasteService",)], "symbol_name string"), "k")
    assert found.count() == 2000
    assert any("posexplode(transform(filter(split(text" in p and "SortMergeJoin [_word" in p for p in plans)
    assert not any("BroadcastHashJoin [_word" in p for p in plans)
