"""The training-data operators against brute force, round trips and SQL, on hard rows and on the small tables."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peerlens.llm import blocknames, catalog, chat, components, langid, mixing, nearcopies, packing, quality, records, simhash, tokens, topk, wordpiece

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, size long, row long, score double, length long, copies long, target double, kept boolean"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))

HARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \t\n ", None, "b"),
    (6, LONG, "en", "b"),
    (7, LONG.upper(), "en", "b"),
    (8, LONG + " end", "en", "ü"),
    (9, "Élan ÉLAN élan naïve", "fr", "ü"),
    (10, "élan élan élan naïve", "fr", "ü"),
    (11, "á á x y z 'S it's don't I'LL 12 3", "fr", "b"),
    (12, "<|endoftext|> <s> </s> 日本語 🙂🙂", None, "a"),
    (None, "no id here", "en", "a"),
    (13, "one", "en", "a"),
    (14, "same text in many rows", "en", "hot"),
    *[(100 + i, "same text in many rows", "en", "hot") for i in range(40)],
]


def rows(data):
    return [(d, t, lang, s, None, "clash", 7, 8, 0.5, 9, 2, 0.1, False) for d, t, lang, s in data]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(HARD), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def small_rows():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), duck(SF), catalog.SQL[name]).startswith("ok")


# 1 and 2: token ids


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("aAzZ'sS tT\n\t.,!%&é́̇İΣ\u0085  \x1c1٣日🙂<|>")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_memo_gives_the_ids_of_whole_texts(texts):
    t = Tokenizer.from_file(WORD_BPE) if not hasattr(test_memo_gives_the_ids_of_whole_texts, "t") else test_memo_gives_the_ids_of_whole_texts.t
    t.encode_special_tokens = True
    test_memo_gives_the_ids_of_whole_texts.t = t
    enc = tokens.encoder(WORD_BPE)
    got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_queries_give_special_tokens_their_own_id(spark, tmp_path):
    import corpus_pipeline

    texts = ["hello <|endoftext|> world", "a<|startoftext|>B, <|ENDOFTEXT|> <|endoftext|>. x", "<|endoftext|><|endoftext|>", "<|endoftext|", None]
    spark.createDataFrame(rows([(i, t, "en", "a") for i, t in enumerate(texts)]), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    t = Tokenizer.from_file(WORD_BPE)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids[0] == [3306, 49407, 1002]
    ended = lambda end: {i: (len(x) + 1, zlib.crc32(np.array([*x, end], "<u4"))) for i, x in enumerate(ids)}
    got = catalog.QUERIES["op1_token_records"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == ended(records.END_ID)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (catalog.QUERIES["op2_best_two_fit"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["pack"](spark, docs, str(tmp_path))):
        assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out.collect()} == ended(packing.END_ID)


def test_very_long_texts_are_cut_at_blanks(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CUT_CHARS", 50)
    enc = tokens.encoder(WORD_BPE)
    texts = [LONG[:3000], None, "x" * 200, "a\nb " * 40, "", "don't  stop\n\n" * 9]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [plain(t) for t in texts]


def test_records_read_back_in_order(spark, hard, plain, tmp_path):
    folder = str(tmp_path / "records")
    manifest = records.write_records(hard, folder, WORD_BPE)
    got = records.read_records(manifest, folder, with_ids=True).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(got) == len(HARD)
    at = 0
    by_id = {d: plain(t) + [records.END_ID] for d, t, *_ in HARD}
    for r in got:
        want = np.array(by_id[r["doc_id"]], "<u4")
        assert r["start"] == at and r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want.tobytes()) and r["ids"] == want.tolist()
        at += len(want)
    shard = max(manifest.collect(), key=lambda m: m["records"])
    last = records.read_at(folder, shard["path"], [shard["records"] - 1, 0])
    assert [x[1].tolist() for x in last] == [by_id[n] for n, _ in last]
    left = [f for f in os.listdir(folder) if not f.endswith(".crc")]
    assert all(f.startswith("part-") for f in left) and len(left) == 2 * manifest.count()


def test_records_of_no_documents(spark, none, tmp_path):
    folder = str(tmp_path / "none")
    assert records.read_records(records.write_records(none, folder, WORD_BPE), folder).count() == 0


def test_damaged_records_are_found():
    data = records.frame(b"abc") + records.frame(b"")
    assert [bytes(p) for p in records.records_of(iter([data[:5], data[5:]]))] == [b"abc", b""]
    for i in range(len(data)):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises((ValueError, Exception)):
            assert [bytes(p) for p in records.records_of(iter([bytes(bad)]))] == [b"abc", b""]


def check_packing(got, docs, plain, capacity):
    bins = defaultdict(list)
    seen = Counter()
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = Counter()
    for d, t, *_ in docs:
        ids = np.array(plain(t) + [packing.END_ID], "<u4")
        for s in range(0, len(ids), capacity):
            p = ids[s : s + capacity]
            want[d, s // capacity, s, len(p), zlib.crc32(p.tobytes())] += 1
    assert seen == want
    return len(bins)


def test_packing_places_every_piece(spark, hard, none, plain):
    check_packing(packing.pack_documents(hard, WORD_BPE).collect(), HARD, plain, 2048)
    check_packing(packing.pack_documents(hard, WORD_BPE, capacity=16).collect(), HARD, plain, 16)
    assert packing.pack_documents(none, WORD_BPE).count() == 0


def test_packed_sequences_hold_the_ids(spark, hard, plain):
    pieces = packing.durable(packing.token_pieces(hard, WORD_BPE, with_ids=True))
    whole = packing.packed_sequences(packing.pack(pieces)).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(len(plain(t)) + 1 for _, t, *_ in HARD)
    assert max(len(r["ids"]) for r in whole) <= 2048


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan_uses_every_length(counts):
    plan = packing.plan_bins(counts, 64)
    used = Counter()
    for b, times in plan:
        assert sum(b) <= 64
        for n in b:
            used[n] += times
    assert used == Counter(counts)
    # No more bins than first fit by falling length, counted piece by piece.
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = next((i for i, g in enumerate(gaps) if g >= n), None)
        if i is None:
            gaps.append(64 - n)
        else:
            gaps[i] -= n
    assert sum(t for _, t in plan) <= max(len(gaps) + 2, 1.1 * len(gaps))


def test_smallest_is_replaced_by_two_that_fit_more_tightly():
    # 60 leaves 40; greedy adds 35 (gap 5); 20 and 19 fill the widened gap of 40 to 39.
    plan = packing.plan_bins({60: 1, 35: 1, 20: 1, 19: 1}, 100)
    assert sorted(plan[0][0], reverse=True) == [60, 20, 19]


# 3: near duplicates


def brute_print(t, k=4):
    w = words(fold(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(prints, radius=4):
    p = np.array(prints, np.uint64)
    parent = list(range(len(p)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


def check_near(got, docs):
    prints = [brute_print(t) for _, t, *_ in docs]
    roots = brute_components(prints)
    least = {}
    for (d, *_), r in zip(docs, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, f"{p:016x}", least.get(r)) for (d, *_), p, r in zip(docs, prints, roots))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(roots))


def test_near_duplicates_of_hard_rows(spark, hard, none):
    check_near(simhash.near_duplicates(hard).collect(), HARD)
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_small_table(spark, small, small_rows):
    check_near(simhash.near_duplicates(small).collect(), small_rows)


@pytest.mark.parametrize("at_once", [1 << 20, 4096])
def test_ball_hashing_links_a_dense_group(spark, monkeypatch, at_once):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(60):
            f = int(c)
            for bit in rng.choice(64, rng.integers(0, 8), replace=False):
                f ^= 1 << int(bit)
            prints.add(f)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    fps = np.array(prints, np.uint64)
    links = list(simhash._meet(fps, np.full(len(fps), 2, np.int8), 64, 2))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (np.bitwise_count(a ^ b) <= 4).all()
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    mine = [find(p) for p in prints]
    brute = brute_components(prints)
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.near_links(simhash.durable(df))).collect()}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    linked = [got.get(p, p) for p in signed]
    assert len(set(zip(linked, brute))) == len(set(linked)) == len(set(brute))


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    chain = [(int(a), int(b)) for a, b in zip(rng.permutation(200)[:-1], rng.permutation(200)[1:])]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    df = spark.createDataFrame(chain + star, "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain + star:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent if n != find(n)}


# 4: chat


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"),
    (1, 1, "assistant", r"[\INST] \ [\\/INST] <\s> </s"),
    (1, 1, "assistant", "</s>"),
    (1, 2, "user", None),
    (1, None, "system", "<s>[SYS]x[/SYS]"),
    (2, 0, "tool[/ROLE]", "[ROLE]a[/ROLE]b</s>"),
    (2, 1, None, "z" * 5000 + "[OUT]"),
    (2, 1, "assistant", ""),
    (None, 0, "assistant", "é🙂\n<<s>s>[[INST]INST]"),
    (None, 0, "assistant", "é🙂\n<<s>s>[[INST]INST]"),
]


def check_chat(spark, turns):
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, at int, shown string")
    made = chat.durable(chat.format_conversations(df))
    got = {r["conv_id"]: r for r in chat.read_formatted(made).collect()}
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(ts)
        assert g["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        assert got[r["conv_id"]]["formatted_chars"] == len(r["formatted"])
        for m in r["loss"]:
            body = r["formatted"][m["start"] : m["start"] + m["length"]]
            assert not re.search(chat.MARK, body)


def test_hard_conversations_come_back(spark):
    check_chat(spark, TURNS)


def test_random_conversations_come_back(spark):
    rng = np.random.default_rng(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", ">", "/", "s", "INST", " a", "\n", "$1"]
    roles = ["user", "assistant", "system", "tool", "<s>", ""]
    turns = [(int(c), int(i), str(rng.choice(roles)), "".join(rng.choice(parts, rng.integers(0, 12)))) for c in range(150) for i in range(rng.integers(1, 6))]
    check_chat(spark, turns)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_formatted(chat.format_conversations(df)).count() == 0


# 5: token counts


def brute_count(word, vocabulary):
    word, i, n = wordpiece.WORD_MARK + word, 0, 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocabulary), None)
        n, i = (n + 1, j) if j else (n + len(word[i].encode()), i + 1)
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab▁é", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcé", min_size=1, max_size=14), max_size=6))
def test_automaton_counts_like_greedy_matching(vocabulary, words_):
    auto = wordpiece.Automaton(vocabulary)
    assert [auto.count(wordpiece.WORD_MARK + w) for w in words_] == [brute_count(w, vocabulary) for w in words_]


def test_token_counts_of_hard_rows(spark, hard, none):
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=PIECES)
    vocabulary = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    got = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in wordpiece.token_counts(hard, PIECES).collect())
    assert got == Counter((d, len(words(t)), sum(brute_count(w, vocabulary) for w in words(t))) for d, t, *_ in HARD)
    assert wordpiece.token_counts(none, PIECES).count() == 0


# 6: exact duplicates


@pytest.mark.parametrize("block", [4096, 3])
def test_exact_duplicates_of_hard_rows(spark, hard, block):
    docs = [r for r in HARD if block > 3 or len(r[1] or "") < 100]
    df = spark.createDataFrame(rows(docs), SCHEMA).repartition(3)
    got = blocknames.exact_duplicates(df, block_chars=block).collect()
    groups = defaultdict(list)
    for d, t, *_ in docs:
        groups[fold(t)].append(d)
    want = Counter()
    for t, ds in groups.items():
        keep = max((d for d in ds if d is not None), default=None)
        for d in ds:
            want[d, keep, len(ds), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_duplicates_of_no_rows(spark, none):
    assert blocknames.exact_duplicates(none).count() == 0


# 7 and 10: classifiers


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int"))
    held_flipped = flipped.where(quality.held_out(flipped["doc_id"])).unionByName(labels.where(~quality.held_out(labels["doc_id"])))
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, held_flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)  # labels of held-out rows play no part


def test_quality_of_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (None, 1, 0), (8, None, 1), (13, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(hard, labels.where("false")).agg({"score": "max"}).first()[0] == 0.5
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.keep_good(hard, labels).columns == hard.columns


def test_windows_of_context_are_counted_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["a", "b", "c", "dd"], 5000))
    batch = pa.RecordBatch.from_pydict({"text": [text, None, "a b"]})
    whole = next(iter(quality._contexts(iter([batch]))))
    place, sign = quality.index_vectors()
    want = np.zeros((quality.VOCAB, quality.DIM))
    for codes in quality.coder().encode([text, "a b"]):
        for i in range(len(codes)):
            for j in range(max(0, i - quality.WINDOW), min(len(codes), i + quality.WINDOW + 1)):
                if i != j:
                    for k in range(quality.NONZERO):
                        want[codes[i], place[codes[j], k]] += sign[codes[j], k]
    got = np.zeros_like(want)
    got[whole.column("code").to_numpy()] = np.array([whole.column(f"d{d}").to_numpy() for d in range(quality.DIM)]).T
    assert np.array_equal(got, want)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op10_language_masks(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_hard_rows(spark, hard, none):
    every = hard["doc_id"].isNotNull()
    f = langid.fit(hard, every)
    got = langid.predict(hard, f).collect()
    assert len(got) == len(HARD)
    for r, t in ((r, next(t for d, t, *_ in HARD if d == r["doc_id"])) for r in got):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
    assert {r["lang_pred"] for r in langid.predict(hard, langid.fit(none, none["doc_id"].isNotNull())).collect()} == {"und"}
    assert langid.predict(none, f).count() == 0


def test_long_texts_are_read_in_cuts(monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(4000))
    f = langid.Filters({"x": langid.grams([text[:9000]])[0], "y": langid.grams([text[9000:]])[0]}, "x")
    whole = f.decide([text, None, "?", text[:50]])
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 1000)
    cut = f.decide([text, None, "?", text[:50]])
    assert cut[0] == whole[0] and cut[0][1:3] == ["und", "und"] and np.allclose(cut[1], whole[1], atol=0.01)


def test_masks_return_every_language_of_a_gram():
    rng = np.random.default_rng(4)
    sets = {f"l{i}": rng.integers(0, 1 << 62, 200, dtype=np.uint64) for i in range(70)}
    sets["l3"] = np.concatenate((sets["l3"], sets["l69"]))
    f = langid.Filters(sets, "l0")
    for i, lang in enumerate(f.langs):
        m = f.masks(sets[lang])
        assert ((m[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    foreign = f.masks(rng.integers(0, 1 << 62, 100_000, dtype=np.uint64))
    for i in (0, 65):
        rate = ((foreign[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        assert abs(rate - f.false[i]) < 0.001


# 8: mixing


def check_mix(got, docs, near):
    by = defaultdict(int)
    for _, t, _, s in docs:
        by[s] += len(words(t))
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), [s for s in order], float(sum(by.values()))
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 3 * by[s]:
                left += target[s] - 3 * by[s]
                target[s] = 3.0 * by[s]
                open_.remove(s)
    taken, sizes = defaultdict(int), Counter()
    source = {(d, len(words(t))): s for d, t, _, s in docs}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        sizes[r["doc_id"], r["size"]] += 1
        taken[s] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["source_size"] == by[s] and abs(r["target"] - target[s]) <= 1e-6 * max(1, target[s])
    assert sizes == Counter((d, len(words(t))) for d, t, *_ in docs)
    for s in order:
        assert abs(taken[s] - target[s]) <= near(s)


def test_mix_of_hard_rows(spark, hard, none):
    top = defaultdict(int)
    for _, t, _, s in HARD:
        top[s] = max(top[s], len(words(t)))
    check_mix(mixing.mix(hard).collect(), HARD, lambda s: top[s])
    assert mixing.mix(none).count() == 0


def test_mix_of_small_table(spark, small, small_rows):
    check_mix(mixing.mix(small).collect(), small_rows, lambda s: 20)


def test_rates_are_those_of_least_divergence(spark, small):
    got = mixing.mix(small).where("size > 0").collect()
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], r["target"]].append((r["size"], r["rate"]))
    for (_, target), xs in by.items():
        assert abs(sum(a * b for a, b in xs) / target - 1) < 1e-6
        free = [(a, np.log(b)) for a, b in xs if b < 3]  # one tilt for all sizes that are below the limit
        tilts = [b / a for a, b in free]
        assert max(tilts, default=0) - min(tilts, default=0) < 1e-9


def test_mixed_documents_repeat_rows(spark, small):
    copies = mixing.mix(small).agg({"copies": "sum"}).first()[0]
    made = mixing.mixed_documents(small)
    assert made.columns == small.columns and made.count() == copies


# 9: top-k


def brute_top(vectors, every, k):
    sound = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
            out |= {(q, n + 1, i, -s_) for n, (s_, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("page,block,query", [(2048, 64, 512), (7, 2, 3)])
def test_top_k_of_hard_vectors(spark, page, block, query):
    rng = np.random.default_rng(6)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 8), 1)]) for i in range(-20, 120)]
    vectors += [(200 + i, vectors[50][1]) for i in range(20)] + [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (500, []), (550, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in vectors], "vec_id long, embedding array<float>, page string, m int")
    got = topk.top_k(df, query_every=10, page_vectors=page, block_vectors=block, query_vectors=query).collect()
    floats = [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in vectors]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(floats, 10, 5)


def test_top_k_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], kind)).count() == 1


def test_blocks_below_the_kth_score_are_not_read(monkeypatch):
    m = np.array([[9, 0], [8, 0], [0, 1], [0, 2], [-5, 0], [-6, 0]], np.int32)
    high, low = (np.array([f(m[i : i + 2], 0) for i in (0, 2, 4)]) for f in (np.max, np.min))
    read = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda q, x: read.append(len(x)) or real(q, x))
    got = topk.score_page(np.array([[3, 0]], np.int32), np.array([99]), np.array([-(2**62)]), np.arange(6), m, high, low, 2, 2)
    assert got == [(99, 0, 27), (99, 1, 24)]
    assert read == [2]  # one block of two vectors


@pytest.mark.parametrize("size", [1e6, 3e6, 4e6])
def test_top_k_is_exact_for_large_components(spark, size):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, size, 4)]) for i in range(60)]
    vectors += [(100, [3e6, 1.0, 0.0, 0.0]), (101, [1e6, 0.0, 0.0, 0.0]), (102, [2e6, 0.0, 0.0, 0.0]), (103, [0.1, -0.2, 0.3, 0.4])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk.top_k(df, query_every=10, page_vectors=8, block_vectors=3, query_vectors=4).collect()
    floats = [(a, [float(np.float32(x)) for x in b]) for a, b in vectors]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == brute_top(floats, 10, 5)


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(df).collect()
    # a pair that cancels out is no reason to refuse
    df = spark.createDataFrame([(0, [1e12, 0.0]), (1, [0.0, 1e12])], "vec_id long, embedding array<float>")
    assert [r["score"] for r in topk.top_k(df).collect()] == [0]


def test_pages_out_of_reach_are_not_emitted():
    rng = np.random.default_rng(9)
    q = rng.integers(1, 9, (5, 6)).astype(float)
    page = lambda i, low, high: {"page": i, "width": 6, "most": topk._pack(np.full((1, 6), high)), "least": topk._pack(np.full((1, 6), low))}
    floor = (q.sum(1) * 50).astype(int).tolist()

    def emitted(summaries):
        kind = pa.struct([("page", pa.int64()), ("width", pa.int64()), ("most", pa.binary()), ("least", pa.binary())])
        cols = {"qb": pa.array([3], pa.int64()), "q_width": pa.array([6]), "q": pa.array([topk._pack(q)], pa.binary()), "floor": pa.array([floor], pa.list_(pa.int64())), "summaries": pa.array([summaries], pa.list_(kind))}
        return [n for b in topk._open(iter([pa.RecordBatch.from_pydict(cols)])) for n in b.column("page").to_pylist()]

    assert emitted([page(i, 0.0, 49.0) for i in range(64)]) == []
    assert emitted([page(i, 0.0, 50.0 if i == 7 else 49.0) for i in range(64)]) == [7]  # a tie is kept


# the pipeline


def test_pipeline_stages_follow_from_each_other(spark, plain):
    import corpus_pipeline

    sf = SF
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = packing.durable(stage(spark, docs, sf))
        if name != "pack":
            assert out.columns == docs.columns
        held[name] = (docs.collect(), out.collect())
        docs = out
    before, after = held["exact_dedup"]
    assert {r["doc_id"] for r in after} == {max(r["doc_id"] for r in before if fold(r["text"]) == t) for t in {fold(r["text"]) for r in before}}
    before, after = held["near_dedup"]
    before = sorted(before, key=lambda r: r["doc_id"])
    roots = brute_components([brute_print(r["text"], 5) for r in before])
    ball = [before[r] for r in sorted(set(roots))]
    left = kept_by_brute([brute_shingles(r["text"] or "") for r in ball])
    assert sorted(r["doc_id"] for r in after) == [ball[r]["doc_id"] for r in left]
    before, after = held["mix"]
    n = Counter(r["doc_id"] for r in after)
    assert max(n.values()) <= 3 and set(n) <= {r["doc_id"] for r in before}
    before, after = held["pack"]
    check_packing(after, [(r["doc_id"], r["text"]) for r in before], plain, 2048)
    assert [r["doc_id"] for r in held["quality"][1]]


def test_pipeline_stages_take_hard_and_empty_tables(spark, hard, none, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (13, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start, some in ((hard, True), (none, False)):
        docs = packing.durable(start)
        for name, stage in corpus_pipeline.STAGES:
            docs = packing.durable(stage(spark, docs, str(tmp_path)))
            assert name in ("quality", "mix") or (docs.count() > 0) == some


def copies_of(rng, similarity, n):
    """A text of n distinct words and one whose set of five-word shingles has about this Jaccard similarity to it."""
    words_ = [f"w{x}" for x in rng.choice(1 << 40, n, replace=False)]
    changed = list(words_)
    shared = 2 * similarity / (1 + similarity) * (n - 4)
    for i in range(round((n - 4 - shared) / 5)):
        changed[7 + 10 * i] = f"new{i}"
    return " ".join(words_), " ".join(changed)


def brute_shingles(text):
    w = words(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_planted_similarity(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts, near = [], []
    for s in (0.5, 0.6, 0.81, 0.85, 0.9, 0.95):
        for _ in range(12):
            a, b = copies_of(rng, s, 200)
            x, y = brute_shingles(a), brute_shingles(b)
            texts += [a, b]
            near.append(len(x & y) / len(x | y) >= 0.8)
    assert 40 < sum(near) < 60
    chain = texts[-2].split()
    for i in range(6):  # each a near copy of the one before, the last not of the first
        texts.append(" ".join(chain))
        chain = chain[:-8] + [f"x{i}y{j}" for j in range(2)]
    docs = packing.durable(spark.createDataFrame(rows([(i, t, "en", "a") for i, t in enumerate(texts)]), SCHEMA))
    for name, stage in corpus_pipeline.STAGES[2 : [k for k, _ in corpus_pipeline.STAGES].index("mix")]:
        docs = packing.durable(stage(spark, docs, SF))
    want = sorted([2 * i for i in range(len(near))] + [2 * i + 1 for i, n in enumerate(near) if not n])
    assert sorted(r["doc_id"] for r in docs.collect()) == want


def kept_by_brute(sets, least=0.8):
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(x & sets[j]) >= least * len(x | sets[j]):
                one, two = sorted((root[i], root[j]))
                root = [one if r == two else r for r in root]
    return sorted(set(root))


def test_near_copies_of_a_template_keep_their_links(spark):
    """One family whose pairs stand just below the bound, with 60 pairs above it among them."""
    rng = np.random.default_rng(12)
    template = [f"t{x}" for x in rng.choice(1 << 40, 1000, replace=False)]
    texts = []
    for _ in range(60):
        own = list(template)
        for k in rng.choice(99, 12, replace=False):
            own[10 * k + 5] = f"own{rng.integers(1 << 50)}"
        twin = list(own)
        twin[3], twin[-4] = "twin3", f"twin{rng.integers(1 << 50)}"
        texts += [" ".join(own), " ".join(twin)]
    sets = [brute_shingles(t) for t in texts]
    between = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[: i - i % 2]]
    assert max(between) >= 0.8 > np.median(between)  # so a star of the first row sees nearly nothing
    docs = packing.durable(spark.createDataFrame(rows([(i, t, "en", "a") for i, t in enumerate(texts)]), SCHEMA))
    got = nearcopies.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_brute(sets)


def test_near_copies_of_one_huge_text(spark):
    """A bucket whose first row is huge and near to none of the others, and copies of the huge text."""
    words_ = [f"h{i}" for i in range(30_000)]
    texts = [" ".join(words_)] + [" ".join(words_[: 29_000 + 100 * i]) for i in range(9)] + [" ".join(words_[100 * i : 100 * i + 60]) for i in range(20)]
    docs = packing.durable(spark.createDataFrame(rows([(i, t, "en", "a") for i, t in enumerate(texts)]), SCHEMA))
    assert sorted(r["doc_id"] for r in nearcopies.drop_near_copies(docs).collect()) == [0, *range(10, 30)]


@given(st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_similarity_matrix(a, b):
    a, b = ([np.array(sorted(set(x)) or [99], np.uint64) for x in side] for side in (a, b))
    want = [[len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) for y in map(np.ndarray.tolist, b)] for x in map(np.ndarray.tolist, a)]
    assert nearcopies.similar(a, b, 0.8).tolist() == want


def test_helper_names_may_stand_in_the_table(spark, tmp_path):
    names = ["__row", "__score", "__place", "__times", "__copy", "__row_", "row", "a.b"]
    data = [(i, f"some text number {i // 2} with words", "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(6)]
    made = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    made.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int")
    for out in (blocknames.drop_exact_duplicates(docs), simhash.drop_near_duplicates(docs), nearcopies.drop_near_copies(docs), mixing.mixed_documents(docs), quality.keep_good(docs, labels)):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)


def test_language_of_cut_texts_is_that_of_whole_ones(monkeypatch):
    text = "Àé bonjour le monde. Straße ÄÖÜ und İ so weiter 123 hello world"
    whole = langid.grams([text])
    for size in (1, 2, 3, 5, 7, 64):
        monkeypatch.setattr(langid, "CHARS_AT_ONCE", size)
        parts = list(langid.cuts(text.lower()))
        h, _, _ = langid.grams([t for t, _, _ in parts], [(a, z) for _, a, z in parts])
        assert sorted(h.tolist()) == sorted(whole[0].tolist())


def test_language_of_a_row_without_id(spark):
    df = spark.createDataFrame([(None, "the of and", "en"), (1, "the of and", "en")], "doc_id long, text string, lang string")
    df.write.mode("overwrite").parquet((d := __import__("tempfile").mkdtemp()) + "/documents.parquet")
    assert {r["doc_id"]: r["held_out"] for r in langid.op10_language_masks(spark, d).collect()}[None] is False


def test_pipeline_drops_near_copies_of_small_table(spark, small, small_rows):
    import corpus_pipeline

    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, small, SF)
    sets = [brute_shingles(t or "") for _, t, *_ in small_rows]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and min(len(x), len(sets[j])) >= 0.8 * max(len(x), len(sets[j])) and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                one, two = sorted((root[i], root[j]))
                root = [one if r == two else r for r in root]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(small_rows[r][0] for r in set(root))


def test_pooled_vectors_and_scores_match_plain_loops(spark):
    """Whole chain of the quality score for a few texts: codes, mean and spread of their vectors, two layers, temperature."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (quality.VOCAB, 2 * quality.DIM)).astype(np.float32)
    vectors[0] = 0
    texts = ["The cat, the cat sat on THE mat.", "one", "", None, "a b a b a b " * 200 + "Ünï 12"]
    net = quality.train(rng.normal(0, 1, (60, 4 * quality.DIM)), rng.random(60) > 0.5, np.arange(60) % 5 == 0)
    got = quality.pooled(texts, vectors)
    for t, row in zip(texts, got):
        codes = [c for piece in (t or "").split(" ") for c in quality.piece_codes(piece)]
        again = sum(codes[i] == codes[i + 1] for i in range(len(codes) - 1)) + sum(codes[i] == codes[i + 2] for i in range(len(codes) - 2))
        codes += [quality._code("^again")] * again
        want = np.zeros(4 * quality.DIM)
        for d in range(2 * quality.DIM):
            held = [float(vectors[c][d]) for c in codes]
            if held:
                mean = sum(held) / len(held)
                want[d], want[2 * quality.DIM + d] = mean, max(0.0, sum(x * x for x in held) / len(held) - mean * mean) ** 0.5
        assert np.allclose(row, want, atol=2e-3)
        hidden = [max(0.0, sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i][h] for i in range(len(row))) + net.b1[h]) for h in range(quality.HIDDEN)]
        logit = sum(a * b for a, b in zip(hidden, net.w2)) + net.b2
        assert abs(net.scores(row[None])[0] - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-6
