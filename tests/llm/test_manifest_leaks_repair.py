"""Merkle manifest, benchmark decontamination and conversation repair: brute force, SQL, hard rows."""

import hashlib
import itertools
import os
import re
import sys
import zlib

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerlens.llm import catalog, decontaminate, merkle, repair

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside stand here as extra columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row long, __spans string, row long, id long, pos long, n long, tree string, leaf string"
TEN = "one two three four five six seven eight nine ten"
DOCS = [
    (1, f"before {TEN.upper()} after", "en", "a", 3),
    (2, f"x {TEN} eleven y {TEN}", "en", "a", None),
    (2, f"x {TEN} eleven y {TEN}", "en", "a", None),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \t..\n ", None, "b", 9223372036854775807),
    (6, "two words; TWO, words... two", "de", "b", 1),
    (None, "no id, two words", "en", "a", 2),
    (7, "ünïts élan ÉLAN 日本語 x", "", "ü", 5),
    (8, "a b " * 4000 + TEN + " c" * 4000, "zz", "b", 2),
    *[(100 + i, "filler text without any leak", "en", "hot", i) for i in range(40)],
]
ITEMS = [(1, TEN), (2, f"{TEN} eleven"), (10, "two words"), (None, "élan É"), (3, None), (4, " .. "), (5, ""), (1, TEN), (77, "a b a b a b a b a b a b")]


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 1, "s", 2, 3, 4, 5, "t", "l") for d in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def own_con(**tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return con


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_benchmark_leaks", "op13_structure_repair"])
def test_queries_match_sql(spark, name):
    result = compare(catalog.QUERIES[name](spark, SF), duck(SF), catalog.SQL[name])
    assert result.startswith("ok"), result


# --- Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(nodes):
    """(root, siblings of each node) by plain runs of two."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            other = nodes[p ^ 1] if p ^ 1 < len(nodes) else None
            paths[i].append((other, p & 1))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        places = [p // 2 for p in places]
    return nodes[0], paths


def brute_manifest(rows):
    def leaf(d, n):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d[0], d[3], d[2], n, d[1])))

    by = {}
    for d in rows:
        by.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(d, d[4]), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {g: tree_of([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    root, tops = tree_of([subs[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for x, path in zip(sorted(by[g], key=lambda x: x[:3]), subs[g][1]):
            d, whole = x[3], path + top
            now = x[2]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0 and d[4] is not None:
                now = leaf(d, d[4] + 1)
            for other, right in whole:
                now = h(now) if other is None else h(other, now) if right else h(now, other)
            proof = h("".join(o or "" for o, _ in whole))
            out.append((d[0], x[2], subs[g][0], root, proof, now, now == root))
    return sorted(out, key=str)


def digested(made):
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(F.concat_ws("", F.transform("proof", lambda s: F.substring(s, 2, 64))), 256)
    return sorted((tuple(r) for r in made.select("id", *hexed, proof, F.lower(F.hex("folded")), F.expr("folded = root")).collect()), key=str)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_matches_brute_force_over_several_tiers(docs, bits):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    made = merkle.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], more, tampered, bits)
    assert digested(made) == brute_manifest(DOCS)


def test_manifest_does_not_depend_on_the_layout(docs):
    args = ("doc_id", "lang", ["doc_id", "text"], {}, F.lit(False))
    a, b = (digested(merkle.manifest(d, *args)) for d in (docs.coalesce(1), docs.repartition(7, "doc_id")))
    assert a == b and all(r[-1] for r in a)


@given(st.integers(1, 70), st.data())
@settings(max_examples=60, deadline=None)
def test_versions_share_untouched_nodes(n, data):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = (n - 1).bit_length()
    tree = merkle.PersistentTree(leaves, levels)
    place = data.draw(st.integers(0, n - 1))
    before, top = len(tree.digest), tree.digest[tree.root]
    new = tree.change(tree.root, place, b"x" * 32)
    assert len(tree.digest) - before == levels + 1  # the leaf and its ancestors, nothing else
    assert tree.digest[tree.root] == top == merkle.fold(leaves[place], tree.path(tree.root, place))
    changed = [*leaves[:place], b"x" * 32, *leaves[place + 1 :]]
    assert tree.digest[new] == merkle.PersistentTree(changed, levels).digest[-1] or n == 1
    assert tree.digest[new] == merkle.fold(b"x" * 32, tree.path(new, place))


def test_manifest_of_nothing_and_of_one(spark, docs):
    args = ("doc_id", "lang", ["doc_id"], {}, F.lit(False))
    assert merkle.manifest(docs.limit(0), *args).collect() == []
    one = merkle.manifest(docs.where("doc_id = 1"), *args).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded and one.proof == []


# --- decontamination


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))


def brute_leaks(rows, given_items):
    grams = {}
    for item, text in given_items:
        w = brute_words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for d in rows:
        w, hit, held = brute_words(d[1]), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    held |= grams[tuple(w[i : i + size])]
        out.append((d[0], len(w), sorted(hit), sorted(held)))
    return sorted(out, key=str)


@pytest.mark.parametrize("set_bytes", [1 << 20, 200])
def test_leaks_match_brute_force_in_one_set_and_in_many(docs, items, set_bytes):
    got = decontaminate.scan(docs, items, set_bytes=set_bytes).collect()
    found = [(r.id, r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r["items"])) for r in got]
    assert sorted(found, key=str) == brute_leaks(DOCS, ITEMS)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_leaks_in_texts_cut_many_times(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "CUT_BYTES", 7)
    assert [w.decode() for c in decontaminate.words_of(DOCS[9][1].encode()) for w in c] == DOCS[9][1].split()
    assert [w.decode() for c in decontaminate.words_of(DOCS[8][1].encode()) for w in c] == brute_words(DOCS[8][1])


def test_leaks_of_nothing(spark, docs, items):
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    clean = decontaminate.scan(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.spans or r["items"] for r in clean)


def test_hit_documents_go_and_clean_ones_stay_as_they_are(spark, docs, items, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    left = decontaminate.decontaminate(docs, items)
    assert left.schema == docs.schema
    clean = sorted(d for d, _, hit, _ in brute_leaks(DOCS, ITEMS) if not hit)
    assert sorted(r.doc_id for r in left.collect()) == clean


def test_spans_are_cut_out(spark, docs, items, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    mended = decontaminate.decontaminate(docs, items, "spans")
    assert mended.schema == docs.schema
    by = {r.doc_id: r.text for r in mended.collect()}
    assert by[1] == "before  after" and by[2] == "x  y " and by[3] is None and by[4] == "" and by[5] == " \t..\n "
    assert by[6] == "... two" and by[100] == "filler text without any leak"
    assert not any(brute_leaks([(0, by[1])], ITEMS)[0][2])


# --- conversation repair


def brute_repair(pattern):
    """The cheapest (cost, audit) over all edits, inserting at most two rows anywhere."""
    n, best = len(pattern), None
    for edits in itertools.product("DKuA", repeat=n):  # u, A: rerole
        cost, roles, letters = 0, [], []
        for letter, e in zip(pattern, edits):
            more = 3 if letter.isupper() else 0
            if e == "D":
                cost += 4
            elif letter == "x":
                break
            else:
                cost += more + (0 if e == "K" else 3)
            roles.append("" if e == "D" else letter.lower() if e == "K" else e.lower())
            letters.append("D" if e == "D" else "K" if e == "K" else "R")
        else:
            # put inserts into every gap by a plain search
            def fill(i, state, c, audit):
                nonlocal best
                if best is not None and c > best[0]:
                    return
                if i == n and state in ("", "a"):
                    best = min(best or (c, audit), (c, audit))
                to = "a" if state == "u" else "u"
                if audit[-3:] != "III" and len(audit) < 2 * n + 3:
                    fill(i, to, c + 3, audit + "I")
                if i < n:
                    r = roles[i]
                    if r == "":
                        fill(i + 1, state, c, audit + letters[i])
                    elif r == to or (r == "s" and state == ""):
                        fill(i + 1, r, c, audit + letters[i])

            fill(0, "", cost, "")
    return best or (0, "")


@pytest.mark.parametrize("size", range(5))
def test_search_matches_brute_force(size):
    for p in itertools.product("suaoxSUA" if size < 4 else "suxU", repeat=size):
        p = "".join(p)
        assert repair.cheapest(p)[:2] == brute_repair(p), p


@given(st.text("suaoxSUAO", max_size=40))
@settings(max_examples=200, deadline=None)
def test_search_gives_legal_conversations_at_its_cost(p):
    cost, audit, plan = repair.cheapest(p)
    roles = "".join((role or p[at].lower())[0] for at, role in plan)
    assert re.fullmatch("(s?(ua)+)?", roles)
    assert sum(c != "I" for c in audit) == len(p) and cost == repair.suffix_bounds(p)[0][0]
    steps = [c for c in audit if c != "I"]
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in audit) + sum(3 for c, e in zip(p, steps) if c.isupper() and e != "D")


def test_long_patterns_take_linear_work():
    cost, audit, plan = repair.cheapest("u" * 50_000)
    assert cost == 75_000 and len(audit) >= 50_000 and len(plan) % 2 == 0


TURNS = [
    *[(1, t, r, x) for t, r, x in [(0, "system", "Be brief."), (1, "user", "Hi?"), (2, "assistant", "Hello."), (2, "assistant", "Hello."), (7, "user", "Cut off")]],
    *[(2, t, r, x) for t, r, x in [(None, "user", "A."), (None, None, None), (3, "tool", "B."), (3, "", "C."), (4, "assistant", "")]],
    (None, 0, "assistant", "No id."),
    (None, None, "user", " \t\x0b\n"),
    (3, -5, "user", "Ünï!"),
    (4, None, "user", "Only nulls."),
    *[(5, t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"Turn {t}" + "." * (t % 5 > 0)) for t in range(200)],
    *[(100 + i, t, ("user", "assistant")[t], "Same words." if t else "Same words?") for i in range(60) for t in (0, 1)],
]


def test_hard_conversations_match_sql(spark, tmp_path):
    rows = [(*t, "clash", 1, 2) for t in TURNS]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, no string, id long, held long").repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = own_con(conversations=pa.table({c: pa.array([t[i] for t in TURNS], k) for i, (c, k) in enumerate(zip(("conv_id", "turn", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string())))}))
    result = compare(repair.op13_structure_repair(spark, str(tmp_path)), con, repair.SQL)
    assert result.startswith("ok"), result


def test_undamaged_conversations(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    by = {r.conv_id: r for r in repair.repair(df).collect()}
    one = by[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (4, 0, 1, 1, 1)
    assert (one.cost, one.audit) == (8, "KKKDD") and [r.role for r in one.repaired] == ["system", "user", "assistant"]
    assert by[4].gaps == 0 and by[4].audit == "KI" and by[4].repaired[1].text == ""
    assert by[None].blank == 1
    assert repair.repair(df.limit(0)).collect() == []
