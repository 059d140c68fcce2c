"""Operators against brute force, the reference tokenizer, SQL and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SMALL, rows
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import byte_bpe, embedding_dedup, folds, language, media, mixing, ngram_join, q02_byte_bpe, q10_media, registry, suffix_dedup, toxicity
from revlens.llm.textscan import Chunk

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(PATH)[0], special_tokens={})


def test_pieces_and_ids_equal_tiktoken():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "\n", "\t", "  ", "é", "1", "٣", "Ⅷ", "!", "\u00a0", "\x1c", "中", "e\u0301", "😀", "\u3000", " '", "\r\n", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, "", "'s's're"]
    chunk = Chunk(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    ids, counts, _, _ = byte_bpe.encode_chunk(chunk, byte_bpe.vocabulary(PATH)[1])
    want, at = encoding(), 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == want.encode_ordinary(text), repr(text)
        at += n


def test_composition_is_associative():
    rng = np.random.default_rng(0)
    f, g, h = rng.integers(0, 256, (3, 500))
    c = byte_bpe.COMPOSE
    assert (c[c[f, g], h] == c[f, c[g, h]]).all()


def test_op2_digests(spark, docs):
    import hashlib

    want = encoding()
    expect = {}
    for r in docs.select("doc_id", "text").collect():
        ids = want.encode_ordinary(r["text"])
        expect[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q02_byte_bpe.run(spark, SMALL).collect()}
    assert got == expect


def test_piece_starts_are_kept(docs):
    text = docs.select("doc_id", "text").first()["text"]
    row = byte_bpe.encode(docs.limit(1).select("doc_id", "text"), PATH, starts="starts").first()
    pieces = [text[a:b] for a, b in zip(row["starts"], [*row["starts"][1:], len(text)], strict=True)]
    assert "".join(pieces) == text and row["ids"] == [i for p in pieces for i in encoding().encode_ordinary(p)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SMALL)) == rows(duck.sql(registry.oracle_sql()[name]))


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _brute_suffix(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        cover = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        hit = np.cumsum(cover[:-1]) > 0 if d else np.zeros(0, dtype=bool)
        edge = np.diff(np.concatenate([[0], hit.astype(int)]))
        out.append((len(d), int(hit.sum()), int((edge == 1).sum()), bytes(b for b, h in zip(d, hit, strict=True) if not h)))
    return out


@pytest.mark.parametrize("hot", [1_000_000, 1500])
def test_suffix_dedup(spark, hot):
    rng = random.Random(5)
    passage, line = _prose(rng, 60), _prose(rng, 12)
    texts = [None, "", "x" * 150, "a" * 1000, "ab" * 700, "é" * 333]
    texts += [f"{_prose(rng, rng.randint(1, 40))}\n{line}\n{_prose(rng, rng.randint(1, 40))}" for _ in range(40)]
    texts += [_prose(rng, rng.randint(0, 30)) + passage + _prose(rng, rng.randint(0, 30)) for _ in range(40)]
    base = _prose(rng, 120)
    texts += [base] * 10 + [base[:k] + "Z" + base[k + 1 :] for k in rng.sample(range(len(base)), 15)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(frame, hot_bytes=hot).orderBy("doc_id").collect()]
    assert got == _brute_suffix(texts, 200)


def test_merged_transforms_find_all_intervals():
    rng = random.Random(3)
    for t in range(20):
        length = 80 if t % 2 else 200
        base = bytes(rng.choice(b"ab" if t % 3 else b"abcdefgh ") for _ in range(600))
        bodies = sorted({base[k : k + rng.randint(length, length + 200)] for k in (rng.randint(0, 300) for _ in range(6))} | {b"a" * (length + 9)})
        bodies = [b for b in bodies if len(b) >= length]
        weights = [rng.choice([1, 1, 2]) for _ in bodies]
        seen = Counter()
        for b, w in zip(bodies, weights, strict=True):
            for i in range(len(b) - length + 1):
                seen[b[i : i + length]] += w
        for b, found in zip(bodies, suffix_dedup.repeated_intervals(bodies, weights, length), strict=True):
            assert [i for s, e in found for i in range(s, e)] == [i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1]


def _brute_join(texts, n, num, den):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = split.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), links[k], find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_join(spark, n, num, den):
    rng = random.Random(9)
    bases = [_prose(rng, k).split(" ") for k in (6, 40, 90, 200)]
    texts = [None, "", "a", "A b", "a  B"]
    for base in bases:
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = _prose(rng, 1)
            texts.append(" ".join(words[: len(words) - rng.randint(0, 3)]))
    texts += [_prose(rng, 30) + " " + " ".join(bases[1]) for _ in range(10)] + texts[5:9]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.join(frame, n=n, num=num, den=den).orderBy("doc_id").collect()]
    assert got == _brute_join(texts, n, num, den)


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    vectors = np.concatenate([centres.repeat(30, 0) + 0.25 * rng.standard_normal((360, 32)), rng.standard_normal((200, 32))])
    vectors[5] = vectors[3]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = np.array([r["n_links"] for r in embedding_dedup.dedup(frame).orderBy("vec_id").collect()])
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.99 * linked.sum()


def test_embedding_dedup_partitions(spark):
    """A third of the rows in one cone, where nearly all pairs link, cut into one or many ranges."""
    rng = np.random.default_rng(5)
    cone = rng.standard_normal(64) + 0.3 * rng.standard_normal((500, 64))
    vectors = np.concatenate([cone, rng.standard_normal((1000, 64))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for parts in (1, 48):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got[parts] = np.array([r["n_links"] for r in embedding_dedup.dedup(frame).orderBy("vec_id").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    print({k: f"{v.sum()} of {want.sum()}" for k, v in got.items()})
    assert (got[1] == got[48]).all() and (got[48] <= want).all() and got[48].sum() >= 0.995 * want.sum()


def test_embedding_dedup_skewed(spark):
    """A third of the rows in a cone of pairwise cosine 0.8 that sign bits hardly split, with planted pairs just above the threshold."""
    rng = np.random.default_rng(6)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    axis = unit(rng.standard_normal(64))
    side = rng.standard_normal((6000, 64))
    side = unit(side - np.outer(side @ axis, axis))
    turn = rng.standard_normal((400, 64))
    turn -= np.outer(turn @ axis, axis)
    turn = unit(turn - (turn * side[:400]).sum(1, keepdims=True) * side[:400])
    side[400:800] = 0.55 * side[:400] + np.sqrt(1 - 0.55**2) * turn
    vectors = np.concatenate([np.sqrt(0.8) * axis + np.sqrt(0.2) * side, unit(rng.standard_normal((12000, 64)))])
    linked = vectors @ vectors.T >= 0.9
    np.fill_diagonal(linked, False)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in embedding_dedup.dedup(frame).orderBy("vec_id").collect()])
    print(f"{got.sum()} of {linked.sum()}")
    assert (got <= linked.sum(1)).all() and got.sum() >= 0.995 * linked.sum() and linked.sum() >= 800


def test_embedding_depths():
    rng = np.random.default_rng(7)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 48, 300), rng.integers(0, 1 << 20, 100), np.full(30, 77)]))
    got = embedding_dedup._depths(keys, 16)
    for k, depth in zip(keys, got, strict=True):
        shared = [((keys >> (48 - bits)) == (k >> (48 - bits))).sum() for bits in range(49)]
        assert depth == next((bits for bits, n in enumerate(shared) if n <= 16), 49)


def _toxic_corpus(spark, n=900):
    """Drawn prose; every fourth text has one or two runs of words of a small bad vocabulary in it."""
    rng = random.Random(12)
    bad = [_prose(rng, 1) + "zz" for _ in range(30)]
    rows, labels = [], []
    for k in range(n):
        words = _prose(rng, rng.randint(20, 200)).split(" ")
        toxic = k % 4 == 0
        for _ in range(rng.randint(1, 2) if toxic else 0):
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) for _ in range(rng.randint(3, 8))]
        if not toxic and rng.random() < 0.1:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.fit(docs.where(~folds.held_out()), labels.where(~folds.held_out()))
    got = toxicity.with_passages(docs.where(folds.held_out()), model).join(labels, "doc_id").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.98 * (n[0, 0] + n.get((0, 1), 0))


def test_toxicity_counts_and_evidence(spark):
    """Document counts of tokens, and every text's evidence from the recursive definition of maximal segments."""
    docs, labels = _toxic_corpus(spark, 120)
    joined = docs.join(labels, "doc_id").withColumn("fold", (F.col("doc_id") % 4).cast("int"))
    got = {r["n"]: r["k"] for r in toxicity._token_counts(joined).groupBy("token").agg((F.sum("y1") + F.sum("y0")).alias("n")).groupBy("n").agg(F.count("*").alias("k")).collect()}
    texts = [r["text"].split(" ") for r in docs.collect()]
    assert got == dict(Counter(Counter(w for t in texts for w in set(t)).values()))
    model = toxicity.fit(docs, labels)
    chunk = Chunk(pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in texts])], names=["text"]), "text")
    _, _, hashes, first = toxicity.words(chunk, toxicity.PUNCTUATION)
    weight = dict(zip(model.terms.tolist(), model.weights.tolist(), strict=True))

    def evidence(scores):
        def best(part):
            if not part:
                return []
            sums = np.concatenate([[0.0], np.cumsum(part)])
            low = np.minimum.accumulate(sums[:-1])
            j = int(np.argmax(sums[1:] - low))
            value = sums[j + 1] - low[j]
            if value <= 1e-9:
                return []
            i = int(np.flatnonzero(np.abs(sums[: j + 1] - low[j]) < 1e-12)[-1])
            return [*best(part[:i]), value, *best(part[j + 1 :])]

        logs = [np.log(model.k * len(scores)) - model.lam * v for v in best(scores)]
        return -sum(x for x in logs if x <= np.log(model.e_max))

    want = [evidence([weight.get(h, model.drift) for h in hashes[a:b].tolist()]) for a, b in zip(first, first[1:], strict=False)]
    assert np.allclose([e for e, _ in toxicity._scored(chunk, model)], want)


def test_language_is_kernel_ridge(spark):
    """The landmark expansion scores as the kernel solution does, with kernels computed pair by pair."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(1, 400 if k % 2 else 500, 60)) for k in range(40)]
    target = np.where(np.arange(40)[:, None] % 2 == np.arange(2)[None, :], 1.0, -1.0)
    marks = list(range(0, 40, 3))
    known = set(np.concatenate([sets[k] for k in marks]).tolist())
    inside = [set(s.tolist()) & known for s in sets]
    kernel = np.array([[len(a & inside[m]) / np.sqrt(len(a) * len(inside[m])) for m in marks] for a in inside])
    alpha = np.linalg.lstsq(kernel.T @ kernel + 1e-3 * 40 * kernel[marks] + 1e-9 * np.eye(len(marks)), kernel.T @ target, rcond=None)[0]
    grams, weights = language.solve(sets, target, marks, 1e-3)
    got = np.array([weights[np.searchsorted(grams, sorted(s))].sum(0) / np.sqrt(len(s)) for s in inside])
    assert np.allclose(got, kernel @ alpha, atol=1e-4)


def test_language_lookups_agree():
    """The direct table and the search find the same n-grams."""
    texts = ["the cat. sat", "日本語 テキスト", "öß ñandú x", "кот и пёс"]
    chunk = Chunk(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    points, _ = language._joined(chunk)
    codes, _ = language._spectrum(points)
    grams = np.unique(codes)[::2]
    table, search = language.Lookup(grams), language.Lookup(grams)
    assert table.table is not None
    search.table = None
    (a, at), (b, there) = table.find(points), search.find(points)
    assert sorted(zip(a.tolist(), at.tolist(), strict=True)) == sorted(zip(b.tolist(), there.tolist(), strict=True)) and (a > 0).sum() >= len(grams)


@pytest.mark.parametrize("same", [7, 8, 9, 11])
def test_language_repeated_ids(spark, same):
    """Thousands of texts of one language under one id, and some that repeat: no language is lost and the sample stays bounded."""
    rng = random.Random(same)
    rows = [(same, f"der hund {_prose(rng, 3)} und die katze ß", "de") for _ in range(5000)] + [(100 + k, f"the dog {_prose(rng, 3)} with a cat", "en") for k in range(100)] + [(same, "ein text", "de")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = frame.select("lang", folds.row_key().alias("key"))
    n = {r["lang"]: r["count"] for r in folds.least_hashed(keys, "lang", 256, 5).groupBy("lang").count().collect()}
    assert n == {"de": 256, "en": 100}
    with pytest.raises(ValueError):
        folds.least_hashed(keys, "lang", 256, 1)
    model = language.fit(frame, rows=64, landmarks=32)
    told = {r["lang_pred"] for r in language.predict(spark.createDataFrame([(1, "die katze und der hund")], "doc_id long, text string"), model).collect()}
    assert model.languages == ["de", "en"] and told == {"de"}


def test_maximal_segments():
    rng = random.Random(2)

    def direct(scores):
        """The recursive definition: the best segment, then what lies on either side of it."""
        best, where = 0.0, None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > best + 1e-9:
                    best, where = total, (i, j)
        if where is None:
            return []
        i, j = where
        return [*direct(scores[:i]), (round(best, 6), j - i), *direct(scores[j + 1 :])]

    for _ in range(200):
        n = rng.randint(1, 25)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        value = [rng.choice([0.7, 1.3, 2.9]) for _ in at]
        scores = [-0.25] * n
        for a, v in zip(at, value, strict=True):
            scores[a] = v
        got = [(round(s, 6), at[j] - at[i]) for s, i, j in toxicity.maximal_segments(at, value, -0.25)]
        assert got == direct(scores)


def test_mixing_meets_targets(spark, docs):
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    equal = lambda natural, domains: np.full(len(natural), natural.sum() / len(natural))
    mixer = mixing.mix(docs, labelled, target=equal)
    out = mixing.assign(docs, mixer).toPandas()
    p = np.stack(out["posterior"])
    reached = (p * (out["rate"] * out["n_tokens"]).to_numpy()[:, None]).sum(0)
    assert np.abs(reached / reached.sum() - 1 / len(reached)).max() < 1e-3
    held = docs.where("doc_id % 2 = 1").select("doc_id", "lang").toPandas().merge(out[["doc_id", "domain"]], on="doc_id")
    assert (held["lang"] == held["domain"]).mean() > 0.9


def test_mixing_is_least_squares(spark, docs):
    """Fitted rates against a dense projected-gradient solution of the same problem, and the totals that ``copies`` reach."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    mixer = mixing.mix(docs, labelled)
    out = mixing.assign(docs, mixer, passes="fraction").toPandas()
    p, t = np.stack(out["posterior"]), out["n_tokens"].to_numpy(dtype=float)
    goal = mixing.tempered((p * t[:, None]).sum(0), mixer.domains)
    share = t / t.sum()
    scale = np.linalg.pinv((p * share[:, None]).T @ p + 1e-9 * np.eye(p.shape[1]))
    r = np.ones(len(t))
    for _ in range(2000):
        r = np.maximum(0, r - p @ (scale @ ((share * r) @ p - goal / t.sum())))
    assert np.abs((share * r) @ p - goal / t.sum()).max() < 1e-4
    assert np.abs(out["rate"].to_numpy() - r).max() < 0.02
    many = np.concatenate([np.floor(out["rate"].to_numpy() + c) for c in (np.arange(200) + 0.5) / 200]).reshape(200, -1).mean(0)
    assert np.abs((share * many) @ p * t.sum() / goal - 1).max() < 0.02


def test_mixing_text_ids_and_many_domains(spark):
    frame = spark.createDataFrame([(f"d{k}", f"{'xyz' if k % 2 else 'abc'} {k}") for k in range(40)], "doc_id string, text string")
    labelled = frame.select("doc_id", F.when(F.col("text").startswith("xyz"), "x").otherwise("a").alias("domain"))
    out = mixing.assign(frame, mixing.mix(frame, labelled)).collect()
    assert all(r["domain"] == ("x" if int(r["doc_id"][1:]) % 2 else "a") for r in out)
    with pytest.raises(ValueError):
        folds.least_hashed(frame.select("doc_id", folds.row_key().alias("key")), "doc_id", 1, 39)


def test_media_recall(spark):
    rng = np.random.default_rng(21)
    base = rng.standard_normal((250, 64))
    vectors = np.concatenate([base, base[:150] + 0.15 * rng.standard_normal((150, 64)), base[:20]])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    prints = media.fingerprint(q10_media.audio_of(frame), rate=q10_media.RATE).cache()
    found = {(r["query_id"], r["match_id"]) for r in media.align(prints, F.col("vec_id") % 7 == 0, row_id="vec_id").collect()}
    table = {r["vec_id"]: np.array(r["fingerprint"], dtype=np.int32) for r in prints.collect() if r["fingerprint"]}
    ids = np.array(sorted(table))
    least = {tuple(table[k]): k for k in ids[::-1].tolist()}
    rep = np.array([least[tuple(table[k])] for k in ids.tolist()])
    bits = np.stack([np.unpackbits(table[k].view(np.uint8)).reshape(-1, 32) for k in ids]).astype(np.float32) * 2 - 1
    n, truth = bits.shape[1], set()
    for q in ids[ids % 7 == 0]:
        own = bits[np.searchsorted(ids, q)]
        for shift in range(-(n // 2), n // 2 + 1):
            size = n - abs(shift)
            same = bits[:, max(0, shift) : max(0, shift) + size].reshape(len(ids), -1) @ own[max(0, -shift) : max(0, -shift) + size].reshape(-1)
            truth |= {(q, m) for m, other in zip(rep[(1 - same / (32 * size)) / 2 <= 0.2].tolist(), ids[(1 - same / (32 * size)) / 2 <= 0.2].tolist(), strict=True) if other != q}
    assert found <= truth and len(found) >= 0.9 * len(truth) and len(truth) > 20


def test_media_rates():
    """One recording at several rates, widths and channels has nearly the same fingerprint."""
    import io
    import wave

    def wav(rate, width, channels):
        at = np.arange(rate * 3) / rate
        tones = [220 * 2 ** (k / 12) for k in (0, 4, 7, 9, 2, 5)]
        signal = np.concatenate([np.sin(2 * np.pi * f * at[: rate // 2]) + 0.5 * np.sin(2 * np.pi * f * 1.5 * at[: rate // 2]) for f in tones]) / 2
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(rate)
            wide = np.repeat(signal, channels)
            f.writeframes((wide * 127 + 128).astype(np.uint8).tobytes() if width == 1 else (wide * (2 ** (8 * width - 1) - 200)).astype(f"<i{width}").tobytes())
        return out.getvalue()

    want = media.packed(media.chroma(media.samples(wav(4000, 2, 1), 4000), 4000))
    assert len(want) > 10
    for rate, width, channels in ((44100, 2, 2), (8000, 4, 1), (22050, 1, 1)):
        got = media.packed(media.chroma(media.samples(wav(rate, width, channels), 4000), 4000))
        n = min(len(got), len(want))
        assert abs(len(got) - len(want)) <= 1 and np.bitwise_count((got[:n] ^ want[:n]).view(np.uint32)).sum() <= 0.1 * 32 * n


def test_code_point_classes_equal_tiktoken():
    """Every code point in the context of a letter, a number and a mark, by a vocabulary whose only merges tell whether a piece goes on."""
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + c: 256 * k + b for k, c in enumerate((b"a", b"1", b"!"), 1) for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20]
    marks = {byte_bpe.LETTER: "a", byte_bpe.NUMBER: "1", byte_bpe.OTHER: "!"}
    kinds = byte_bpe.code_point_classes()
    assert [c for c in points if (mark := marks.get(int(kinds[c]))) and probe.encode_ordinary(chr(c) + mark)[-1] < 256] == []
    blank = [c for c in points if kinds[c] == byte_bpe.BLANK]
    assert all(probe.encode_ordinary(chr(c) + m)[-1] < 256 for c in blank for m in "a1!")


def test_offsets_are_held_against_tokens(spark):
    frame = spark.createDataFrame([(1, "Hello wörld, it's 42 日本"), (2, None), (3, "")], "doc_id long, text string")
    encoded = byte_bpe.encode(frame, PATH, offsets="at", starts="starts")
    row = next(r for r in byte_bpe.decode(encoded, PATH, offsets="at").collect() if r["doc_id"] == 1)
    raw, text = bytes(row["decoded"]), "Hello wörld, it's 42 日本"
    assert [raw[a:b].decode() for a, b in zip(row["at"], [*row["at"][1:], len(raw)], strict=True)] == [text[a:b] for a, b in zip(row["starts"], [*row["starts"][1:], len(text)], strict=True)]
    with pytest.raises(Exception, match="inside a token"):
        byte_bpe.decode(encoded.withColumn("at", F.transform("at", lambda x: x + 1)), PATH, offsets="at").collect()
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(encoded.withColumn("ids", F.array(F.lit(10**8))), PATH).collect()


def test_ngram_join_shared_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(3, a), (5, f"{a} x"), (5, b), (7, f"{b} y"), (9, None), (5, ""), (11, "zz")]
    got = {(r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=9, den=10).collect()}
    assert got == {(3, 58, 1, 3), (5, 59, 1, 3), (5, 58, 1, 3), (7, 59, 1, 3), (9, 0, 0, 9), (5, 0, 0, 5), (11, 1, 0, 11)}


def test_embedding_extremes(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 0.0]), (4, [0.0, -1e-200]), (5, [5e200, 1e199])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_pipeline_identity(spark):
    """Ids that are null or shared by several texts."""
    rng = random.Random(8)
    a, b, c, d = (_prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " end"), (None, c), (None, c), (None, d), (3, d + " end"), (4, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, frame, SMALL).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (1, b), (None, c), (3, d + " end"), (4, None), (4, "")], key=str)
    for same in (5, None):
        lines = spark.createDataFrame([(same, "a\nb\nc\nx", 7), (same, "a\nb\nc\ny", 7)], "doc_id long, text string, n_chars long")
        assert sorted(len(r["text"]) for r in corpus_pipeline.cut_repeated_lines(spark, lines, SMALL).collect()) == [1, 7]


def test_pipeline_stages(spark):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    raw = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    assert set(out["doc_id"]) <= set(raw["doc_id"]) and {"ids", "n_tokens"} <= set(out.columns) and "text" not in out.columns
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        assert set(r[0] for r in kept.select("doc_id").collect()) <= set(raw["doc_id"]), name


def _brute_lines(rows, width=3):
    """Texts after the later places of windows are covered; a place is an id, a line and a text."""
    first = {}
    keys = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda k: k[:2])
    lines = {k: k[2].split("\n") for k in keys}
    for k in keys:
        for at in range(len(lines[k]) - width + 1):
            window = tuple(lines[k][at : at + width])
            if any(x.strip(" ") for x in window):
                first.setdefault(window, []).append((k, at))
    hidden = {}
    for places in first.values():
        for k, at in places[1:]:
            hidden.setdefault(k, set()).update(range(at, at + width))
    return {k: "\n".join(x for j, x in enumerate(lines[k]) if j not in hidden.get(k, ())) for k in keys}


def test_pipeline_stages_are_brute_force(spark):
    """Each stage on a drawn corpus with nulls, empties, repeats and a clashing column, against plain Python."""
    rng = random.Random(31)
    shared = "\n".join(_prose(rng, 6) for _ in range(5))
    rows = [(k, f"{_prose(rng, 30)}\n{_prose(rng, 8)}") for k in range(30)]
    rows += [(40 + k, f"{_prose(rng, 20)}\n{shared}\n{_prose(rng, 20)}") for k in range(4)]
    rows += [(50 + k, rows[k][1] + " tail") for k in range(5)] + [(60, None), (61, ""), (62, None), (63, rows[0][1])]
    frame = spark.createDataFrame([(i, t, None if t is None else len(t), "en", "clash") for i, t in rows], "doc_id long, text string, n_chars long, lang string, component_id string")
    cut = corpus_pipeline.cut_repeated_lines(spark, frame, SMALL)
    want = _brute_lines(rows)
    expect = [(i, t if t is None else want[(True, i, t)]) for i, t in rows]
    expect = [(i, new) for (i, new), (_, old) in zip(expect, rows, strict=True) if not (old and new == "")]
    got = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert cut.columns == frame.columns and sorted(got, key=str) == sorted(expect, key=str)
    joined = _brute_join([t for _, t in rows], 5, 4, 5)
    keep = {min(rows[k][0] for k in range(len(rows)) if joined[k][2] == c) for c in {j[2] for j in joined}}
    near = corpus_pipeline.drop_near_copies(spark, frame, SMALL)
    assert near.columns == frame.columns and sorted(r["doc_id"] for r in near.collect()) == sorted(keep)
    tokens = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, frame, SMALL).collect()}
    assert all(tokens[i]["ids"] == encoding().encode_ordinary(t or "") and tokens[i]["n_tokens"] == len(tokens[i]["ids"]) for i, t in rows)
    nothing = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0, name


def test_pipeline_toxicity_and_mixing(spark):
    """Kept documents are those below one half; mixing repeats each as its rate says and loses none."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SMALL)
    scores = {r["doc_id"]: r["score"] for r in registry.queries()["op9_toxicity"](spark, SMALL).collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(k for k, v in scores.items() if v < 0.5)
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, SMALL).select("doc_id").collect())
    copies = {r["doc_id"]: r["copies"] for r in registry.queries()["op7_mixing"](spark, SMALL).collect()}
    assert mixed == copies
