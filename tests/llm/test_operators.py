"""Operators for training data against plain versions, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bpe, catalog, exact, jaccard, language, learning, lines, nearest, packing, quality, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "removed", "ids", "decoded", "rank", "name", "key", "row", "label", "piece", "start", "length", "digest", "place", "tree", "held_out", "_source", "_text_hash"]
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
LINES = "one line here\nanother line there\nthird line now\nfourth of them"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def docs(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (5, LONG), (5, LONG), (6, LINES), (7, "start\n" + LINES), (None, LINES), (8, "ünï 漢字 😀 <|endoftext|>"), (9, "a\n\n\n\n\n\nb"), (10, PASSAGE), (11, "x\n" + PASSAGE.upper() + "\ny")]


@pytest.fixture(params=[False, True], ids=["plain", "clash"])
def odd(spark, request):
    return docs(spark, ODD, request.param)


@pytest.fixture()
def empty(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(catalog.vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def strings(n, seed):
    alphabet = [*"abc the ing 12 \n\t .,!'sé漢😀  -=", "    ", "　", "\x1c", " \n"]
    draw = random.Random(seed)
    return ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(n)]


# 1: byte-level BPE


def test_ids_are_the_library_s(vocabulary, library):
    import public_tokenizers

    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    words = bpe.WordEncoder(encoder.encode_words, encoder.encode_bytes)
    texts = strings(3000, 1) + [LONG, "thththth" * 300]
    for text, found in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(found, "<i4").tolist() == encoder.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_give_the_same_ids_as_anew(vocabulary, library):
    import public_tokenizers

    encoder, draw = bpe.Encoder(vocabulary, public_tokenizers.PATTERN), random.Random(2)
    for text, more in zip(strings(100, 3), strings(100, 4), strict=True):
        edited = bpe.EditableText(encoder, text)
        edited.append(more[:5])
        a = draw.randint(0, len(text))
        b = draw.randint(a, len(text))
        want = text + more[:5]
        edited.edit(a, b, more[5:9])
        want = want[:a] + more[5:9] + want[b:]
        assert edited.text == want and edited.ids == library.encode_ordinary(want)


def test_bpe_round_trip(odd, empty, library):
    import public_tokenizers

    path = catalog.vocabulary("byte_bpe_50k.tiktoken")
    for df, n in ((odd, len(ODD)), (empty, 0)):
        encoded = bpe.encode_documents(df, path, public_tokenizers.PATTERN)
        rows = bpe.decode_documents(encoded, path).select("text", "ids", "decoded").collect()
        assert len(rows) == n
        assert all(list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") for r in rows)


@pytest.mark.parametrize("size", [20_000, 200_000])
@pytest.mark.parametrize("kind", ["letters", "white", "no spaces"])
def test_memory_is_linear_in_a_piece(vocabulary, library, kind, size):
    import tracemalloc

    import public_tokenizers

    draw = random.Random(8)
    alphabet = {"letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "white": " \t\u3000", "no spaces": "漢字仮名交文"}[kind]
    text = "".join(draw.choices(alphabet, k=size))
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    words = bpe.WordEncoder(encoder.encode_words, encoder.encode_bytes)
    for whole in (text, f"x {text[1:]}y"):
        # Tracing is slow; what the long piece needs shows on the short one.
        if size == 20_000:
            tracemalloc.start()
        found = np.frombuffer(words.encode([whole])[0], "<i4").tolist()
        if size == 20_000:
            assert tracemalloc.get_traced_memory()[1] < 20_000_000
            tracemalloc.stop()
            assert found == library.encode_ordinary(whole)
        assert b"".join(map(vocabulary.bytes_of.__getitem__, found)).decode() == whole
    assert all(len(w) <= bpe.SHORT_BYTES for w in words.known)


# 2: packing


def test_pieces_are_the_library_s(spark, odd):
    from tokenizers import Tokenizer

    path = catalog.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    found = defaultdict(list)
    for r in packing.pieces(odd.where("doc_id is null or doc_id <> 5"), path, 64).orderBy("piece").collect():
        assert r.length <= 64 and (r.piece == 0 or r.length == 64)
        assert r.start == sum(map(len, found[r.doc_id]))
        found[r.doc_id].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    for i, t in ODD:
        if i != 5:
            assert sum(found[i], []) == [*library.encode(t or "", add_special_tokens=False).ids, 0]


def best_fit(lengths, capacity):
    """Best fit, longest first, one piece at a time: the number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(4))
def test_sweep_packs_like_best_fit(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 40 if seed % 2 else 100) for _ in range(600)] + [37] * 300
    placed, gone = defaultdict(list), Counter()
    for s in packing.sweep(Counter(lengths), 100):
        for k in range(s["rank_to"] - s["rank_from"]):
            placed[s["sequence_from"] + k // s["each"]].append((s["offset"] + k % s["each"] * s["length"], s["length"]))
            gone[s["length"]] += 1
    assert gone == Counter(lengths)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(placed) <= best_fit(lengths, 100)


def test_packed_rows_fill_sequences(odd, empty):
    rows = catalog.packed(odd).collect()
    whole = defaultdict(list)
    for r in rows:
        whole[r.sequence_id].append((r.offset, r.length))
    assert all(all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and sum(n for _, n in x) <= 2048 and min(x)[0] == 0 for x in whole.values())
    assert len(whole) == -(-sum(r.length for r in rows) // 2048)
    assert catalog.packed(empty).count() == 0
    parts = packing.pieces(odd, catalog.vocabulary("byte_bpe_50k.json"), 2048)
    full = packing.sequences(packing.pack(parts, 2048, ["doc_id", "piece"])).collect()
    assert sum(len(r.ids) // 4 for r in full) == sum(r.length for r in rows)
    with pytest.raises(ValueError):
        packing.pack(parts, 16, ["doc_id", "piece"])


# 3, 4, 9: classifiers


def test_marginals_are_those_of_all_paths():
    from itertools import product

    draw = np.random.default_rng(1)
    emission, transition = draw.normal(size=(2, 4, 2)), draw.normal(size=(2, 2))
    mask = np.array([[True] * 4, [True, True, False, False]])
    got, _, log_sum = quality.marginals(emission, mask, transition)
    total = 0.0
    for d, n in enumerate((4, 2)):
        weight = np.zeros((n, 2))
        for path in product((0, 1), repeat=n):
            w = np.exp(sum(emission[d, t, s] for t, s in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                weight[t, s] += w
        assert got[d, :n] == pytest.approx(weight / weight.sum(axis=1, keepdims=True))
        total += np.log(weight[0].sum())
    assert log_sum == pytest.approx(total)


def test_line_features_count_repeats():
    features, counts, sizes = quality.documents_lines(["go go go stop\nABC", None, ""])
    assert counts.tolist() == [2, 1, 1] and sizes.tolist() == [13, 3, 0, 0]
    assert features[0, quality.KINDS + 2] == 0.5 and features[0, quality.KINDS + 3] == 0.5
    assert features[1, 1] == 1.0 and np.isfinite(features).all()


def accuracy(found, truth, guess):
    rows = found.where("held_out").select((F.col(truth) == F.col(guess)).cast("int").alias("hit")).agg(F.avg("hit"), F.count("*")).first()
    return rows[0], rows[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    hit, n = accuracy(catalog.op3_quality(spark, sf).join(labels, "doc_id"), "quality", "predicted")
    assert n > 500 and hit > 0.96
    hit, n = accuracy(catalog.op4_toxicity(spark, sf).join(labels, "doc_id"), "toxic", "predicted")
    assert n > 500 and hit > 0.95
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    hit, n = accuracy(catalog.op9_language(spark, sf).join(truth, "doc_id"), "lang", "lang_pred")
    assert n > 500 and hit > 0.99


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 0, 1), (8, 1, 0), (9, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for classify in (quality.classify, toxicity.classify):
        for df, n in ((odd, len(ODD)), (empty, 0)):
            for known in (labels, labels.limit(0)):
                rows = classify(df, known).select("doc_id", "held_out", "score", "predicted").collect()
                assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
        assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    rows = language.identify(odd.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang")))).collect()
    assert len(rows) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1 for r in rows)
    nothing = language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify(empty).count() == 0


def test_unseen_misspellings_score_high():
    clean = ["the river ran along quiet meadows", "a table of plain numbers", "birds sing in the morning"] * 20
    foul = [t + " you blitherskite" for t in clean]
    model = toxicity.train(clean + foul, np.array([0] * 60 + [1] * 60), 12)
    scorer = toxicity.Scorer(model)
    assert scorer.score("the birds blitherskyte blytherskite blitherskiter") > 0.5 > scorer.score("quiet birds in the morning")


def test_tables_of_byte_pairs_equal_the_filters():
    draw = np.random.default_rng(3)
    windows = draw.integers(0, 256, (3, language.WINDOW), dtype=np.uint8)
    model = language.train(windows, np.array([0, 1, 1]), 2, epochs=1)
    got = language.Scorer(model, ["a", "b"]).windows(windows)
    pooled = []
    for w in language.WIDTHS:
        x = model["embedding"][windows]
        out = sum(x[:, j : language.WINDOW - w + 1 + j] @ model[f"filter{w}"][j] for j in range(w))
        pooled.append(out.max(axis=1))
    want = learning.log_softmax(np.tanh(np.concatenate(pooled, 1)) @ model["weights"] + model["bias"])
    assert got == pytest.approx(want, abs=1e-3)


def test_fold_is_the_crc_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", learning.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


# 5, 8: repeated units and lines


def plain_passages(rows, min_words):
    """Character spans to be removed, by place in `rows` (id, text): seeds, extended word by word against units beside the first, chained."""
    units = []
    for key, text in rows:
        found, at = [], 0
        for unit in re.split(r"\n+|(?<=[.!?])\s+", (text or "").lower()):
            if unit.split():
                found.append((at, unit.split()))
                at += len(unit.split())
        units.append(found)

    def rank(k, place):
        key, text = rows[k]
        hashed = int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)
        return (float("inf"), hashed, place) if key is None else (key, 0, place)

    first = {}
    for k, found in enumerate(units):
        for j, (at, words) in enumerate(found):
            first[tuple(words)] = min(first.get(tuple(words), ((float("inf"), 1 << 64, 0), 0, 0)), (rank(k, at), k, j))
    out = []
    for k, found in enumerate(units):
        words, runs = [w for _, u in found for w in u], {}
        for at, unit in found:
            keep, m, j = first[tuple(unit)]
            if keep == rank(k, at):
                continue
            a, b = at, at + len(unit)
            if keep[:2] != rank(k, 0)[:2]:
                source = [w for _, u in units[m] for w in u]
                low = units[m][max(0, j - substring.BESIDE)][0]
                high = units[m][j + 1 + substring.BESIDE][0] if j + 1 + substring.BESIDE < len(units[m]) else len(source)
                x, y = keep[2] - 1, keep[2] + len(unit)
                while a > 0 and x >= low and words[a - 1] == source[x]:
                    a, x = a - 1, x - 1
                while b < len(words) and y < high and words[b] == source[y]:
                    b, y = b + 1, y + 1
            runs.setdefault((keep[:2], keep[2] - at), []).append(set(range(a, b)))
        gone = set()
        for parts in runs.values():
            marked = sorted(set().union(*parts))
            start = 0
            for i in range(1, len(marked) + 1):
                if i == len(marked) or marked[i] != marked[i - 1] + 1:
                    if i - start >= min_words:
                        gone.update(marked[start:i])
                    start = i
        where = [m.span() for m in re.finditer(r"\S+", rows[k][1] or "")]
        spans = []
        for w in sorted(gone):
            if spans and w - 1 in gone:
                spans[-1][1] = where[w][1] - spans[-1][0]
            else:
                spans.append([where[w][0], where[w][1] - where[w][0]])
        out.append([tuple(s) for s in spans])
    return out


def test_repeated_passages_go(odd, empty):
    rows = substring.deduplicate(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[11].text == "x\n\ny" and [(s.start, s.length, s.keep_id) for s in by_id[11].removed] == [(2, len(PASSAGE), 10)]
    assert all(r.text == dict(ODD)[r.doc_id] and not r.removed for r in rows if r.doc_id != 11)
    assert substring.deduplicate(empty).count() == 0


@pytest.mark.parametrize("least", [4, 9])
def test_passages_are_followed_to_their_ends(spark, least):
    draw = random.Random(least)
    source = [draw.choice("abcdefg") * draw.randint(1, 2) + draw.choice(["", "", "", ".", ",", "\n"]) for _ in range(200)]
    rows = []
    for i in range(40):
        own = [f"{draw.choice('rstuv')}{draw.randint(0, 5)}{draw.choice(['', '', '. '])}" for _ in range(draw.randint(0, 20))]
        for _ in range(draw.randint(0, 2)):
            a, at = draw.randrange(180), draw.randint(0, len(own))
            own[at:at] = source[a : a + draw.randint(3, 20)]
        rows.append((draw.choice([i, i, i, 7, None]), " ".join(own)))
    want = plain_passages(rows, least)
    got = sorted(((r.doc_id, r.text, [(s.start, s.length) for s in r.removed]) for r in substring.deduplicate(docs(spark, rows), least, slice_bytes=200).collect()), key=str)
    cut = ["".join(c for i, c in enumerate(t) if not any(a <= i < a + n for a, n in spans)) for (_, t), spans in zip(rows, want, strict=True)]
    assert got == sorted(((k, t, s) for (k, _), t, s in zip(rows, cut, want, strict=True)), key=str)
    assert any(want)


def plain_line_dedup(rows, n):
    """Positions to delete: those in a run of n lines that has started before."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts = [p.strip(" \t\r\x0b\x0c") for p in (text or "").split("\n")] if text is not None else []
        gone = set()
        for i in range(len(parts) - n + 1):
            run = tuple(parts[i : i + n])
            if run in seen:
                gone.update(range(i, i + n))
            seen.add(run)
        out[key] = sorted(gone)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_repeated_runs_of_lines_go(spark, n):
    draw = random.Random(n)
    rows = [(i, "\n".join(draw.choice("abc") * draw.choice([1, 1, 2]) for _ in range(draw.randint(1, 12)))) for i in range(60)]
    got = {r.doc_id: r for r in lines.deduplicate(docs(spark, rows), n).collect()}
    want = plain_line_dedup(rows, n)
    for i, text in rows:
        assert list(got[i].removed) == want[i]
        assert got[i].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])


def test_line_dedup_on_odd_rows(odd, empty):
    rows = lines.deduplicate(odd).collect()
    assert len(rows) == len(ODD) and sum(r.text is None for r in rows) == 1
    want = plain_line_dedup(list(dict(ODD).items()), 3)
    assert all(list(r.removed) == want[r.doc_id] for r in rows)
    assert lines.deduplicate(empty).count() == 0


def test_line_dedup_is_native(odd):
    plan = lines.deduplicate(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "Cartesian", "NestedLoop"))


# 6: exact dedup


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("size", [1, 3, 2048])
def test_equal_texts_share_one_identity(spark, size):
    rows = [(i, t) for i, t in enumerate(["", None, "ab c", "abc", "a\tbc ", "abcd", "abcabc", "abc abc", "abcab", "x" * 5000, "x" * 5001, "é", "é"] * 3)]
    found = exact.identities(docs(spark, rows), size=size).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r.level, r.name].add(normal(rows[r.doc_id][1]))
    assert len(found) == len(rows) and all(len(g) == 1 for g in groups.values())
    assert len(groups) == len({normal(t) for _, t in rows})


def test_exact_dedup_on_odd_rows(odd, empty):
    rows = exact.deduplicate(odd).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[normal(t)].append((-len(t or ""), i is None, i))
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) == len(groups)
    for r in rows:
        text = normal(dict(ODD)[r.doc_id])
        assert (r.keep_id, r.group_size) == (min(groups[text])[2], len(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert exact.deduplicate(empty).count() == 0


# 7: exact top-k search


def plain_top_k(vectors, k):
    out = []
    scaled = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in scaled:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(scaled[q], scaled[c], strict=True)), c) for c in scaled if c != q and len(scaled[c]) == len(scaled[q]))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "huge"])
def test_top_k_is_exact(spark, kind):
    draw = np.random.default_rng(5)
    values = draw.normal(size=(400, 6)) * (1e6 if kind == "huge" else 1)
    if kind == "ties":
        values = np.round(values) * 0.25
        values[100:300] = 0.25
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(values)]
    vectors += [(500, None), (550, [1.0, None]), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, []), (701, []), (750, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "vector": F.lit("x"), "dims": F.lit(2)})
    got = nearest.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(vectors, 5)
    assert nearest.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 10: near copies


def plain_join(rows):
    shingler = jaccard.Shingler()
    sets = [set(shingler(t).tolist()) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0]))
                parent[b] = a
    return sorted(((i, rows[find(k)][0], links[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [4, 256])
def test_no_link_is_lost(spark, block):
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base) if i % 3 else [f"v{draw.randint(0, 400)}" for _ in range(120)]
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            text[draw.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(text)))
    got = jaccard.join(docs(spark, rows), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_join(rows)


def test_jaccard_join_on_odd_rows(odd, empty):
    assert sorted((tuple(r) for r in jaccard.join(odd).collect()), key=str) == plain_join(ODD)
    assert jaccard.join(empty).count() == 0


def test_prefix_is_shortened_to_the_target():
    assert jaccard.prefix_length(0.8, 16, 8, 0.9999) == 3
    assert jaccard.prefix_length(0.8, 16, 8, 0.9) > 3


# Pipeline


def test_stages_on_the_given_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf)
        rows = {r.doc_id: r.text for r in before.collect()}
        if k == 0:
            bad = {r.doc_id for r in toxicity.classify(before, catalog.labels(spark, sf)).where("predicted = 1").collect()}
            want = {i: t for i, t in rows.items() if i not in bad}
        elif k == 1:
            gone = plain_line_dedup(rows.items(), lines.MIN_LINES)
            want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in rows.items()}
            want = {i: t for i, t in want.items() if t or not gone[i]}
        elif k == 2:
            want = {i: rows[i] for i, c, _ in plain_join(sorted(rows.items())) if i == c}
        elif k == 3:
            order = sorted(rows.items())
            spans = plain_passages(order, substring.MIN_WORDS)
            want = {i: substring.cut(t, [{"start": a, "length": n} for a, n in s]) for (i, t), s in zip(order, spans, strict=True)}
            assert {r.doc_id: r.n_removed for r in after.collect()} == {i: len(s) for (i, _), s in zip(order, spans, strict=True)}
        else:
            assert {r.doc_id for r in after.collect()} == set(rows)
            break
        after.write.parquet(str(tmp_path / str(k)))
        before = spark.read.parquet(str(tmp_path / str(k)))
        assert before.columns[: len(corpus_pipeline.COLUMNS)] == corpus_pipeline.COLUMNS
        assert {r.doc_id: r.text for r in before.collect()} == want, name
    assert set(want) <= set(given)


def test_one_row_of_each_near_group_stays(spark):
    words = [f"n{i}" for i in range(100)]
    other = [f"o{i}" for i in range(100)]
    near = [*words[:99], "changed"]
    rows = [(1, words), (1, words), (1, other), (2, near), (3, other), (None, near), (None, near), (None, words[:60] + other[:60]), (None, other[:60] + words[:60]), (None, other[:60] + words[:60])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(4, ""), (5, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[7], rows[10], rows[11]], key=str)
    # A near copy under an id whose other text is not one.
    rows = [(1, " ".join(words)), (2, " ".join(near)), (2, " ".join(other))]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()]
    assert sorted(got) == [rows[0], rows[2]]


def test_run_returns_packed_pieces(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_a_piece_is_encoded_once_whatever_stands_beside_it():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    vocabulary = bpe.Vocabulary(catalog.vocabulary("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    words = bpe.WordEncoder(encoder.encode_words, encoder.encode_bytes)
    seen, encode = [], vocabulary.encode_pieces
    vocabulary.encode_pieces = lambda pieces: seen.extend(pieces) or encode(pieces)
    texts = ["a wordly word", "a wordly, word", "a (wordly word."]
    got = [words.encode([t])[0] for t in texts]
    assert seen.count(" wordly") == 1 and seen.count(" word") == 1
    assert got == [bpe.Encoder(bpe.Vocabulary(catalog.vocabulary("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).encode_bytes(t) for t in texts]


def test_piece_cache_is_bounded(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "CACHED_PIECES", 8)
    vocabulary = bpe.Vocabulary(catalog.vocabulary("byte_bpe_50k.tiktoken"))
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    for i in range(50):
        text = f"w{i} some more {'x' * 200}{i} words"
        assert b"".join(vocabulary.bytes_of[k] for k in encoder.encode(text)) == text.encode()
        assert len(encoder._known) < 20 and max(map(len, encoder._known)) <= bpe.SHORT_BYTES
