"""Each operator against brute force, on rows with nulls, empty and long texts, repeats and extra
columns, and on empty tables."""

import hashlib
import itertools
import random
import re

import pytest
import xxhash

pytest.importorskip("vellum.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from vellum.llm import compression, decontaminate, graph, language_id, licenses, near_copies, ordinal, pieces, preference, queries, repeats, simhash, token_counts  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, n_words long, gram int, id string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi omega".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, 2, "clash") for i, t in rows], DOCS)


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and long texts, repeated rows, one id with two texts, shared passages."""
    shared, short = prose(1, 45), prose(2, 20)
    rows = [(i, prose(100 + i, 60)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (None, prose(7, 30)), (None, None), (None, prose(7, 30) + " x")]
    rows += [(30, f"{prose(3, 9)} {shared} {prose(4, 9)}"), (31, f"{shared}\n{shared}"), (32, short), (33, short.replace(" ", "\n  ")), (34, short.upper())]
    rows += [(40, rows[3][1]), (40, rows[3][1]), (41, rows[3][1] + " more"), (42, rows[4][1]), (42, rows[5][1])]
    rows += [(50, prose(9, 20_000) + " " + shared), (51, "a b c"), (52, "a b c"), (53, "Äß ÉÀ é 中文  x")]
    return rows


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, duck, compare, name):
    compare(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op6_preference_pairs"}))
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# --- 1: decontamination


def alnum(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(rows, items, window=13):
    phrases = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = alnum(text), set(), set()
        for p, ids in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        near = 0
        for p in phrases:
            exact = any(tuple(w[i : i + len(p)]) == p for i in range(len(w) - len(p) + 1))
            near += not exact and set(p) <= set(w) and any(all(p[j] in w[max(0, a + j - 2) : max(0, a + j + 3)] for j in range(len(p))) for a in range(-2, len(w)))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), 0 < len(w) <= 20 * len(hit) and len(hit) > 0, near))
    return out


def items_of(rows):
    words = rows[4][1].split()
    swapped = " ".join(w for a, b in zip(words[::2], words[1::2]) for w in (b, a))
    return [(8, swapped), (9, " ".join(words[:6] + words[8:20])), (1, rows[0][1][30:170]), (2, rows[3][1]), (3, "A b"), (10, "B-C!"), (4, None), (5, "..."), (None, rows[5][1]), (6, rows[0][1][60:]), (6, rows[0][1][60:]), (7, "nowhere at all")]


def key(rows):
    return sorted(map(repr, rows))


def test_decontamination(spark, odd):
    items = items_of(odd)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    brute = contaminated(odd, items)
    assert any(r[6] for r in brute)
    want = key(brute)
    assert key(map(tuple, decontaminate.op1(table(spark, odd), bench).collect())) == want
    # small segments and several blocks of the benchmark
    rows = decontaminate.contamination(table(spark, odd), bench, slop=2, segment_bytes=600, block_bytes=150).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.contaminated, r.n_near) for r in rows]
    assert key(got) == want


def test_clean_documents_keep_columns(spark, odd):
    bench = spark.createDataFrame([(2, odd[3][1])], "item_id bigint, text string")
    docs = table(spark, odd)
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    bad = {r[0] for r in contaminated(odd, [(2, odd[3][1])]) if r[5]}
    assert key((r.doc_id, r.text) for r in kept.collect()) == key((i, t) for i, t in odd if i not in bad)


def test_clean_rows_stay_beside_contaminated_ones(spark):
    item = prose(11, 30)
    rows = [(None, item), (None, prose(12, 30)), (None, None), (7, item), (7, prose(13, 30)), (8, prose(14, 30))]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontaminate.clean_documents(table(spark, rows), bench)
    assert key((r.doc_id, r.text) for r in kept.collect()) == key((i, t) for i, t in rows if t != item)


def test_proximity(spark):
    item = "one two three four five six"
    docs = table(spark, [(1, "x one two three four five six y"), (2, "one two three extra four five six"), (3, "one two three a b c d four five six"), (4, "one two three"), (5, "four five six")])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(docs, bench, slop=1).collect()}
    assert rows == {1: (6, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


# --- 2: SimHash


def brute_fingerprint(t):
    w = space_words((t or "").translate({i: i + 32 for i in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    return [(rows[i][0], f"{prints[i]:016x}", least[label[i]]) for i in range(len(rows))]


def test_simhash(spark, odd):
    near = [(200 + k, prose(70, 300) + f" tail{k}") for k in range(25)]
    rows = odd + near
    assert key(map(tuple, simhash.op2(table(spark, rows)).collect())) == key(brute_groups(rows))


def test_simhash_on_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert key(map(tuple, simhash.op2(docs).collect())) == key(brute_groups(rows))


def test_masks_cover():
    masks = simhash.masks(4)
    assert len(masks) == 31
    r = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(not flips & m for m in masks)
    small = simhash.masks(2, 10)
    assert all(any(not sum(1 << b for b in s) & m for m in small) for s in itertools.combinations(range(10), 2))


def test_links_in_chunks(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    points = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(300)} | {r.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    label = {p: p for p in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
            x, y = label[a], label[b]
            if x != y:
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    for most in (16, 100_000):
        found = {r.node: r.root for r in graph.components(simhash.links(frame, most=most)).collect()}
        assert all(found.get(p, p) == v for p, v in label.items())


def test_one_of_each(spark, odd):
    docs = table(spark, odd)
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    groups = {}
    for (i, t), (_, _, c) in zip(odd, brute_groups(odd)):
        groups.setdefault(c, []).append(i)
    kept = [r.doc_id for r in got.collect()]
    assert sorted(x for x in kept if x is not None) == sorted(c for c in groups if c is not None)


def test_similar_texts_are_one(spark):
    """Every pair of a 5-word similarity of 0.8 or more is linked, whatever its digests, and none below."""
    rows = []
    for i in range(40):
        words = prose(1000 + i, 100).split()
        rows += [(10 * i + k, " ".join([*words[:50], *["other"] * (k > 0), *words[50 + k :], *["end"] * (k == 2)])) for k in range(3)]
        rows += [(10 * i + 5, " ".join([*words[:30], "one", *words[31:55], "two", *words[56:80], "three", *words[81:]]))]
    rows += [(1000, ""), (1001, None), (None, "a b"), (1002, "A  B")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root = [root[a] if r == root[b] else r for r in root]
    want = {}
    for (i, _), r in zip(rows, root):
        want.setdefault(r, set()).add(i)
    docs = table(spark, rows)
    for most, bucket in ((150, 40), (600, 100_000), (2_000_000, 100_000)):
        got = {}
        for r in near_copies.groups(docs, most, bucket).collect():
            got.setdefault(r.root, set()).add(r.doc_id)
        assert sorted(map(str, got.values())) == sorted(map(str, want.values()))
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    far = {r.component_id for r in simhash.groups(docs.where("doc_id < 1000")).collect()}
    assert len(far) > len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (7, 6)]
    for chunk in (4, 1 << 20):
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), chunk).collect()}
        assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}
    assert not graph.components(spark.createDataFrame([(4, 4)], "a bigint, b bigint")).collect()


def test_thinned_edges_connect_the_same():
    import numpy as np
    import pyarrow as pa

    def roots(edges):
        root = {x: x for x in want_nodes}
        for _ in want_nodes:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    r = random.Random(3)
    for _ in range(60):
        edges = [(r.randrange(40) * 7 - 50, r.randrange(40) * 7 - 50) for _ in range(r.randint(1, 70))]
        want_nodes = {x for e in edges for x in e}
        batches = [pa.record_batch([pa.array(x) for x in np.array(edges[i : i + 7], np.int64).T], names=["a", "b"]) for i in range(0, len(edges), 7)]
        for chunk in (4, 20, 1000):
            found = [tuple(row.values()) for b in graph._thinned(iter(batches), chunk) for row in b.to_pylist()]
            assert roots(found) == roots(edges)
            assert chunk < 1000 or len(found) == len(want_nodes) - len(set(roots(edges).values()))


# --- 3: token counts


ODD_TEXTS = ["a<|endoftext|>b c", "x<|startoftext|> <|endoftext|>", "it's don'T 12 a_b!!  \n\x1c q", "é ́a", "İstanbul ſ ΑΣ Σ\tΣ", "\x85a\x85 b", "", "  ", "中文字 ok", "x" * 5000, "a1b22C3" * 2000, "7" * 9000, "1é2ß3" * 2000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, odd, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    rows = odd + list(enumerate(ODD_TEXTS, 900))
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 50) for i, t in rows]
    assert key(map(tuple, token_counts.token_counts(table(spark, rows), path, over=50, batch_bytes=64).collect())) == key(want)
    assert token_counts.load(path)[1] == (name == "word_bpe_49k.json")


def test_token_cache_starts_anew(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [prose(i, 30) for i in range(20)]
    want = token_counts.count_tokens(texts, path)
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    assert [token_counts.count_tokens([t], path)[0] for t in texts] == want


# --- 4: pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(lattice, text):
    """All segmentations of a short text with its space mark, as scores."""

    def go(rest):
        if not rest:
            yield 0.0
            return
        for n in range(1, min(len(rest), lattice.longest) + 1):
            got = lattice.pieces.get(rest[:n])
            score = got[1] if got else lattice.unknown if n == 1 else None
            if score is not None:
                yield from (score + s for s in go(rest[n:]))

    return sorted(go(" " + text), reverse=True)


def test_pieces_forget_what_exceeds_their_bound(lattice):
    small = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 7]) for i in range(0, 400, 3)] + [" ".join(words)]

    def rows(of):
        return [(of.encode(t), of.library(t)) for t in texts]

    want = rows(lattice)
    assert rows(small) == want and len(small.known) == 400
    small.keep(50)
    for _ in range(2):
        assert max(map(len, (small.known, small.older, small.merges))) <= 50 and len(small.lists) <= 5
        assert rows(small) == want


def test_pipeline_bounds_what_workers_remember(monkeypatch, spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    given, segmented = [], pieces.segmented

    def watched(*args, **options):
        given.append(options.get("remembered", pieces.REMEMBERED))
        return segmented(*args, **options)

    monkeypatch.setattr(pieces, "segmented", watched)
    pipeline.encoding(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert given == [pipeline.REMEMBERED] and pipeline.REMEMBERED <= 100_000


@pytest.mark.parametrize("text", ["hello", "a b", "the cat", "\n", "x\ny", "ab  c", "é▁😀", " lead", "end ", "aaaaaa"])
def test_n_best_is_brute_force(lattice, text):
    got = lattice.encode(text, 5)
    assert [s for s, _ in got] == segmentations(lattice, text)[:5]
    assert len({i for _, i in got}) == len(got)
    assert all(lattice.decode(i) == text for _, i in got)


def test_n_best_fewer_than_asked(lattice):
    assert lattice.encode("", 3) == [(0, b"")]
    assert len(lattice.encode("\n", 3)) == len(segmentations(lattice, "\n"))


def test_pieces_round_trip(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = odd + list(enumerate(ODD_TEXTS, 900))
    docs = table(spark, rows)
    assert pieces.op4(docs).where("not round_trip").count() == 0
    best = pieces.encoded(docs, path, 2).selectExpr("doc_id", "best[0].ids ids")
    assert key(map(tuple, pieces.decoded(best, path).collect())) == key((i, t or "") for i, t in rows)


def test_library_ids(lattice, odd):
    import numpy as np
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in [t or "" for _, t in odd] + ODD_TEXTS + ["  a  b \n\n c", "\nword\n", "x▁y ▁", " ", "tab\tbed"]:
        assert np.frombuffer(lattice.library(text), "<i4").tolist() == model.encode(text)


def test_long_unit_takes_linear_time(lattice):
    import time

    text = "".join(random.Random(1).choices("abcdefghij", k=200_000))
    began = time.time()
    got = lattice.encode(text, 3)
    assert len(got) == 3 and lattice.decode(got[0][1]) == text
    assert time.time() - began < 30


# --- 5: language


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op5(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, sf_dir):
    learned = language_id.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names, scores = learned.predict([None, "", "123 !?", "the and of that", "x", "中文", "der die und nicht"])
    assert names[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    assert names[3] == "en" and names[6] == "de" and all(n in learned.languages for n in names[3:])
    none = language_id.learn(spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, lang string"))
    assert none.predict(["text"]) == (["und"], [0.0])


def test_filters_have_no_false_negatives(spark):
    import numpy as np

    rows = [(i, "wort haus baum", "de") for i in range(3)] + [(9 + i, "word house tree", "en") for i in range(3)]
    f = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for i, text in ((0, " wort haus baum "), (1, " word house tree ")):
        for size in language_id.SIZES:
            h = language_id.grams(np.frombuffer(text.encode(), np.uint8), size)
            found = np.bitwise_and.reduce([f.masks[0][language_id.slots(h, k)] for k in range(language_id.HASHES)])
            assert (found >> i & 1).all()


def test_many_languages(spark):
    rows = [(100 * i + j, f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:02}") for i in range(70) for j in range(3)]
    f = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(f.masks) == 2
    assert f.predict([t for _, t, _ in rows[::3]])[0] == [x for _, _, x in rows[::3]]


# --- 6: preference pairs


def test_preference_edges(spark):
    turn = lambda r, t: {"role": r, "text": t}
    a = [turn("user", "hi"), turn("assistant", "yo"), turn(None, None)]
    rows_c = [(1, a), (2, a), (3, a), (4, []), (5, a[:1])]
    rows_r = [(1, a[:2] + [turn("assistant", "x")]), (2, a), (4, a), (5, a[:2])]
    schema = f"id bigint, turns {preference.TURNS}"
    got = {r.id: r for r in preference.format_pairs(spark.createDataFrame(rows_c, schema), spark.createDataFrame(rows_r, schema)).collect()}
    assert [got[i].n_common for i in (1, 2, 3, 4, 5)] == [2, 3, 0, 0, 1]
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[1].chosen == "<|im_start|>\n<|im_end|>\n"
    assert [got[1].rejected[s.start : s.stop] for s in got[1].rejected_spans] == ["x<|im_end|>"]
    assert got[2].chosen == got[2].rejected == "" and got[3].rejected is None
    assert not any(got[i].usable for i in (1, 2, 3, 4, 5))


def test_conversations_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"), (2, 1, "assistant", "z"), (2, 0, None, None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, id string")
    got = {r.id: [tuple(t) for t in r.turns] for r in preference.conversations(frame).collect()}
    assert got == {1: [("user", "a"), ("user", "b")], 2: [(None, None), ("assistant", "z")]}
    empty = preference.op6(frame.limit(0))
    assert empty.count() == 0


# --- 7: ordinal


def test_ordinal_orders_grades():
    import numpy as np

    r = random.Random(3)
    texts, grades = [], []
    for i in range(300):
        g = i % 3
        texts.append(prose(i, r.randint(20, 60)) + (" vile" if g == 0 else " dull" if g == 1 else ""))
        grades.append(g)
    model = ordinal.fit([ordinal.features(t).astype(np.int32) for t in texts[:240]], np.array(grades[:240]), 3)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(texts[240:])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (((tails > 0.5).sum(axis=1)) == np.array(grades[240:])).mean() > 0.9


def test_ordinal_edges(spark, odd, sf_dir):
    docs = table(spark, odd)
    none = spark.createDataFrame([(None, None, None), (1, None, None)], "doc_id bigint, quality int, toxic int")
    assert ordinal.op7(docs, none).where("kept").count() == len(odd)
    bad = spark.createDataFrame([(1, 0, 0), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    assert ordinal.op7(docs, bad).where("kept").count() == 0
    real, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = ordinal.good_documents(real, labels)
    assert got.columns == real.columns
    wrong = ordinal.op7(real, labels).join(labels, "doc_id").where("kept <> (quality = 1 and toxic = 0)").count()
    assert wrong <= 0.05 * labels.count()


# --- 8: compression bands


def brute_base(t):
    w = space_words(t)
    lines, dup = set(), 0
    for x in (t or "").split("\n"):
        if space_words(x):
            dup += x in lines
            lines.add(x)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_counts(odd):
    texts = [t for i, t in odd if i != 50] + ["a b c d e a b c d e", "x\nx\n \n \nx", "# * $|é&<>%", "a a a a a a a", ("q w e r t " * 3).strip() + " z", "a\x0bb\x0cc\x1cd e"]
    for t in texts:
        assert compression.base_counts(t.encode() if t is not None else None) == brute_base(t)


def test_base_counts_of_long_texts(odd, monkeypatch):
    texts = [t for _, t in odd if t] + ["x\n\n y\x0bz \n" * 30, "a b c d e f " * 50, prose(1, 300, ["a", "b"]), " lead and trail  " * 9, "Äß 中文\n" * 20]
    plain = [compression.base_counts(t.encode()) for t in texts]
    monkeypatch.setattr(compression, "LONG_BYTES", 0)
    assert [compression.base_counts(t.encode()) for t in texts] == plain
    same = lambda raw, starts, ends: compression.np.zeros(len(starts), compression.np.uint64)
    monkeypatch.setattr(compression, "_word_hashes", same)  # all hashes clash
    assert [compression.base_counts(t.encode()) for t in texts if len(t) < 5000] == [p for p, t in zip(plain, texts) if len(t) < 5000]


def test_verdicts_are_brute_force():
    import zstandard

    r = random.Random(4)
    compress = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    inside = lambda b, n: next((lo <= len(b) / len(compress(b)) <= hi for least, lo, hi in reversed(compression.BANDS) if n >= least), True)
    texts = [prose(i, r.randint(45, 3000)) for i in range(30)] + ["same words again " * k for k in (20, 200, 2000)] + [prose(i, 400) + "z9Qx" * r.randint(0, 300) for i in range(30)]
    kept = []
    for t in texts:
        b = t.encode()
        fine = inside(b, len(b))
        for size in (256, 2048):
            if len(b) >= size:
                at = sorted({*range(0, len(b) - size + 1, size), len(b) - size})
                fine = fine and 50 * sum(not inside(b[i : i + size], size) for i in at) <= len(at)
        kept.append(fine)
        assert compression.Bands().judge(b)[3] == fine
    assert 0 < sum(kept) < len(kept)


def test_bands(spark):
    import base64

    noise = base64.b64encode(random.Random(1).randbytes(9000)).decode()
    rows = [(1, prose(1, 1500)), (2, " ".join(noise[i : i + 7] for i in range(0, 9000, 7))), (3, " ".join(f"same{i % 6}" for i in range(4000))), (4, None), (5, "few words"), (6, prose(2, 40))]
    got = {r.doc_id: r for r in compression.op8(table(spark, rows)).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, False, False, False, False, True]
    assert got[2].ratio < 1.5 and not got[2].base_failed and got[4].n_words == 0 and got[4].base_failed


def test_bands_see_noise_anywhere():
    import base64

    def noise(n):
        text = base64.b64encode(random.Random(n).randbytes(n)).decode()
        return " ".join(text[i : i + 7] for i in range(0, n, 7))[:n]

    plain = "The harbour was quiet in the morning, and a few boats came back before the rain. Nobody had seen the old man since he left for the northern islands. "
    fine = [" ".join(prose(i, 20_000)[: 2000 + 900 * i].split()) for i in range(4)] + [plain]
    spoiled = [fine[0][:2000] + " " + noise(1900), fine[3] + " " + noise(1500) + " " + fine[3], fine[0][:1800] + noise(300), noise(240), plain[:100] + noise(130)]
    bands = compression.Bands()
    assert [bands.judge(t.encode())[3] for t in fine] == [True] * 5
    assert [bands.judge(t.encode())[3] for t in spoiled] == [False] * 5


# --- 9: repeats


def brute_repeats(rows, window):
    """Places are (id, start); null ids come first, by the hash of the text."""
    first = {}
    places = []
    for i, t in rows:
        w = space_words(t)
        place = (0, xxhash.xxh64_intdigest((t or "").encode(), 42) ^ 0, 0) if i is None else (1, i, 0)
        places.append((w, place))
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, (*place[:2], k)), (*place[:2], k))
    out = []
    for (i, _), (w, place) in zip(rows, places):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (*place[:2], k):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 3, 50_000])
def test_repeats(spark, odd, most):
    rows = [r for r in odd if r[0] is not None or r[1] is None]
    docs = table(spark, rows * 2)
    got = [(r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in repeats.without_repeats(docs, most=most).collect()]
    assert key(got) == key(brute_repeats(rows, 20) * 2)


def test_repeats_of_few_words(spark):
    """Few different words: long runs, overlaps of a passage with itself, hot anchors."""
    rows = [(i, prose(i, 150, ["a", "b"]) if i % 3 else "a " * (30 + i)) for i in range(40)]
    for most in (4, 1000):
        got = repeats.without_repeats(table(spark, rows), window=6, gram=3, most=most)
        got = [(r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()]
        assert key(got) == key(brute_repeats(rows, 6))


def test_null_ids_come_first(spark):
    text = prose(1, 30)
    got = {r.doc_id: r.n_words - len(r.kept.split()) for r in repeats.without_repeats(table(spark, [(-5, text), (None, text), (1, None)])).collect()}
    assert got == {-5: 30, None: 0, 1: 0}


def test_cut_documents(spark):
    shared = prose(1, 30)
    rows = [(1, f"start\n{shared}\nend"), (2, f"other  one\n\n{shared}\n\ttail"), (3, shared), (4, None), (5, "")]
    docs = table(spark, rows)
    got = repeats.cut_documents(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {
        1: (rows[0][1], len(rows[0][1])), 2: ("other  one\n\n\n\ttail", 18), 3: ("", 0), 4: (None, 0), 5: ("", 0),
    }


# --- 10: licenses


def test_license_scan(spark):
    texts = [
        "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 3.",
        "this work is  licensed under the gnu general public license, version 3",
        "The work is licensed under a GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License.",
        "This work is licensed under the GNU General Public License, version 7.",
        "My driving license ran out, and nothing else is in this line of text at all.",
        None,
        "",
        'x\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
        "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n\ny",
    ]
    rows = {r.doc_id: [(n.license, n.first_line) for n in r.notices] for r in licenses.license_scan(table(spark, list(enumerate(texts)))).collect()}
    assert rows[0] == [("Apache-2.0", 1)] and rows[1] == [("GPL-2.0", 0)]
    assert rows[2] == rows[3] == rows[4] == [("GPL-3.0", 0)]
    assert rows[5] == [("CC-BY-NC-4.0", 0), ("MIT", 1), ("MIT", 2)]
    assert rows[6] == rows[7] == rows[8] == rows[9] == []
    assert rows[10] == [("Apache-2.0-header", 2)]


def test_notices_among_other_words(spark):
    scan = lambda t: [(x[0], x[1], x[2], x[4]) for x in licenses.Scanner().scan(t.encode())]
    assert scan("Copyright (c) 2019 Harbour Press Ltd. All rights reserved.") == [("reserved", 0, 0, 0)]
    assert scan("This book was scanned by volunteers in 2014. Released under the MIT License.") == [("MIT", 0, 0, 0)]
    long = prose(5, 400)
    for name, (notice, _) in licenses.TEMPLATES.items():
        assert scan(f"{long} {notice} {long}") == [(name, 0, 0, 0)]
        assert scan(f"{long} {notice.upper()}\n{long}") == [(name, 0, 0, 0)]
    two = f"{long} Released under the MIT License. {long}\nLicensed under the Apache License,\nVersion 2.0. All rights reserved. {long}"
    assert scan(two) == [("MIT", 0, 0, 0), ("Apache-2.0", 1, 2, 0), ("reserved", 2, 2, 0)]
    assert scan("This work is licensed under the GNU Lesser General Public License, version 3.") == [("LGPL-3.0", 0, 0, 0)]


def test_whole_texts_with_changes():
    """Other holders, other line breaks and a comment sign per line; one notice per place."""
    scanner = licenses.Scanner()
    for name in ("MIT-text", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0-notice", "GPL-3.0-header", "Unlicense-text"):
        words = licenses.TEMPLATES[name][0].replace("COPYRIGHT HOLDERS", "REGENTS OF THE UNIVERSITY").split()
        lines = ["# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        found = scanner.scan("\n".join(["# Copyright (c) 2020 Somebody", *lines, "# end"]).encode())
        assert [x[0] for x in found] == [name] and found[0][4] <= 6, name


def brute_notices(scanner, block):
    """Each template aligned with the whole block at every place of any of its telling words."""
    hits = set()
    for name in scanner.names:
        words = scanner.words[name]
        more = int(licenses.DIFFERENT * len(words)) + 1
        for k, w in enumerate(block):
            for i in [j for j, x in enumerate(words) if x == w and w in scanner.telling[name]]:
                low, high = max(0, k - i - more), min(len(block), k - i + len(words) + more)
                if hit := scanner.fit(name, block[low:high]):
                    hits.add(name)
    return hits


def test_no_template_is_missed(spark, sf_dir):
    """What all places of all telling words confirm, the rarest word's places confirm too."""
    scanner = licenses.Scanner()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where("text rlike '(?i)licen[sc]e|copyright|rights reserved'").limit(60).collect()
    for (text,) in rows:
        for block in re.split(r"\n\s*\n", text):
            if licenses.CUES.search(block.encode()):
                words = licenses.words_of(block)
                got = {x[2] for x in scanner.notices(words)}
                brute = brute_notices(scanner, words)
                assert got <= brute and bool(got) == bool(brute)


def test_templates_tell_themselves_apart():
    scanner = licenses.Scanner()
    for name, (text, _) in licenses.TEMPLATES.items():
        hit = scanner.confirm(text.encode())
        assert hit and hit[0] == name and hit[2] == 0
    exact = licenses.TEMPLATES["GPL-3.0"][0]
    steps = scanner.differences("GPL-3.0", licenses.words_of(exact.replace("General", "Specific")))
    assert steps == [("replace", ["general"], ["specific"])]


# --- the pipeline


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = pipeline.run(spark, sf_dir).collect()
    assert all(r.round_trip for r in rows)
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) < docs.count()
    kept = labels.join(ordinal.op7(docs, labels).where("kept"), "doc_id").select("doc_id")
    groups = {r.doc_id: r.component_id for r in simhash.op2(docs.join(kept, "doc_id", "left_semi")).collect()}
    assert all(groups.get(i, i) == i for i in ids if i in groups)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, odd)
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert got.count() <= len(odd), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(odd)
