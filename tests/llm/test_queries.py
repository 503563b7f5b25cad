"""The registered queries on the smallest tables, against brute force, libraries and the pipeline's own rules."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tidewise.llm import edits, langid, lines, minhash, shard

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SF)


def test_all_ten_and_the_pipeline_are_registered():
    names = [n for n in QUERIES if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_sql_twins(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    twin, got = db.sql(__spark_entry__.oracle_sql()[name]), run(spark, name)
    columns = sorted(got.columns)
    order = [list(twin.columns).index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in order) for r in twin.fetchall())


def test_language_is_learned_without_the_held_out(spark, documents):
    got = run(spark, "op1_language_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(documents) and held
    assert np.mean([r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held]) > 0.9


def test_words_of_code_switched_text_are_labelled(spark, documents):
    docs = collections.defaultdict(list)
    for r in documents.values():
        docs[r["lang"]].append(r["text"])
    model = langid.fit({k: v[:40] for k, v in docs.items()})
    a, b = (" ".join(langid.letters_only(docs[k][-1]).split()[:30]) for k in ("en", "fr"))
    posterior, sizes = langid.label_words(model, [f"{a} {b}"])
    found = [model.languages[k] for k in posterior.argmax(1)]
    assert sizes.tolist() == [len(found)]
    assert np.mean([x == y for x, y in zip(found, ["en"] * len(a.split()) + ["fr"] * len(b.split()))]) > 0.9
    assert np.allclose(posterior.sum(1), 1, atol=1e-4)


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, transition, start = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    posterior, _, z = langid.forward_backward(scores, np.array([4]), transition, start)
    want, total = np.zeros((4, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(scores[t, p] for t, p in enumerate(path)) + sum(transition[p, q] for p, q in zip(path, path[1:])))
        total += w
        for t, p in enumerate(path):
            want[t, p] += w
    assert np.allclose(posterior, want / total) and np.isclose(z, np.log(total))


def brute_components(texts, size):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, sets


def test_near_duplicates(spark, documents):
    comps, sets = brute_components({k: r["text"] for k, r in documents.items()}, 4)
    got = run(spark, "op2_minmax_hash").collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in got} == {k: (c, len(sets[k]), c == k) for k, c in comps.items()}


def test_bpe_round_trip(spark, documents):
    for r in run(spark, "op6_byte_bpe").collect():
        assert r["decoded_sha256"] == hashlib.sha256((documents[r["doc_id"]]["text"] or "").encode()).hexdigest()


def test_toxicity_of_held_out_documents(spark):
    """On documents whose labels weren't seen: toxic ones score above clean ones, and nearly all are predicted right."""
    place = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, place).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{place}/labels.parquet").collect()]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for k, r in got.items())
    held = [(got[k]["score"], t) for k, t in labels if k in got and got[k]["held_out"]]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert bad and good and np.mean([a > b for a in bad for b in good]) > 0.95
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.95


def test_language_of_every_document_follows_the_model(spark, documents):
    """The query against the model applied text by text."""
    train = {k: r for k, r in documents.items() if zlib.crc32(str(k).encode()) % 4 != 2}
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(train))))
    got = {r["doc_id"]: r for r in run(spark, "op1_language_id").collect()}
    assert all(r["held_out"] == (k not in train) for k, r in got.items())
    for k, r in list(documents.items())[:60]:
        (language,), (score,) = langid.score(model, [r["text"]])
        assert got[k]["lang_pred"] == language and abs(got[k]["score"] - score) < 1e-4


def test_shards_by_a_plain_feistel_network(spark, documents):
    """Every row of the query against the definition, a number at a time."""
    order = sorted(documents.values(), key=lambda r: (r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1))
    n, keys = len(order), shard.round_keys(29)
    bits = shard.half_bits(n)

    def walk(x):
        while True:
            high, low = x >> bits, x & ((1 << bits) - 1)
            for key in keys:
                y = (low * shard.FIRST + key) & 0x7FFFFFFF
                y ^= y >> 13
                y = (y * shard.SECOND) & 0x7FFFFFFF
                high, low = low, high ^ ((y ^ (y >> 11)) & ((1 << bits) - 1))
            x = high << bits | low
            if x < n:
                return x

    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), "rows", walk(k) % 8, walk(k) // 8, None) for k, r in enumerate(order)}
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in run(spark, "op7_feistel_shards").collect()}
    assert got == want


def test_token_ids_equal_the_libraries(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    bytewise = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    six = {r["doc_id"]: r for r in run(spark, "op6_byte_bpe").collect()}
    eight = {r["doc_id"]: r for r in run(spark, "op8_token_files").collect()}
    for k in sorted(documents):
        text = documents[k]["text"] or ""
        ids = bytewise.encode_ordinary(text)
        assert (six[k]["n_tokens"], six[k]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        ids = [*words.encode(text, add_special_tokens=False).ids, 2]
        assert (eight[k]["start"], eight[k]["n_tokens"], eight[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_nearest_vectors_against_exact_search(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, unit = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = collections.defaultdict(dict)
    for r in run(spark, "op5_multiprobe_nearest").collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    right = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.argsort(-cosine, kind="stable")[:5]
        right, total = right + sum(int(ids[b]) in found[int(ids[q])] for b in best), total + 5
        assert all(abs(s - cosine[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found[int(ids[q])].items())
    assert right >= 0.9 * total


@pytest.mark.parametrize("rows", [0, 12])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    """Nulls, empty texts, repeated rows and columns of clashing names through all five stages."""
    good = "the house on the hill was old and nobody had lived there for many years before we came\nwe opened the windows"
    texts = [None, "", " \n", "12 34", good, good, good + " today", "le chat dort sur la table de la cuisine pendant que la pluie tombe", "x y", "a\n\n\nb", "word " * 5000, good]
    made = [(None if k == 3 else k // 2, t, None if k == 5 else "fr" if t and t.startswith("le") else "en", None if k % 4 == 0 else "web", len(t) if t else None, 1, "r") for k, t in enumerate(texts)][:rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, size int, row string").withColumns({c: F.lit(0) for c in ("gone", "key", "place", "rid", "_at", "score")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "ids"} <= set(got.columns)
    kept = got.collect()
    assert (rows == 0 and not kept) or {r["doc_id"] for r in kept} >= {2} and all(r["decoded_sha256"] for r in kept)


def test_pipeline_against_a_plain_version(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect() or [], docs.schema) if name != "byte bpe" else stage(spark, docs, SF)
        if name != "byte bpe":
            assert docs.columns == columns
        after.append(docs.collect())
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    language, score = langid.score(model, [r["text"] for r in documents.values()])
    assert {r["doc_id"] for r in after[0]} == {k for k, lang, s in zip(documents, language, score) if lang != "und" and s >= 0.4}
    # of all lines that stay no two are equal when normalised, and every line that went has one alike that stays
    stays = [c for r in after[1] for x in r["text"].split("\n") if (c := lines.normalised(x))]
    assert len(stays) == len(set(stays))
    left = {r["doc_id"]: collections.Counter(map(lines.normalised, r["text"].split("\n"))) for r in after[1]}
    went = {c for r in after[0] for c in collections.Counter(map(lines.normalised, r["text"].split("\n"))) - left.get(r["doc_id"], collections.Counter()) if c} - set(stays)
    for c in went:
        near = [x for x in stays if 0.9 * len(c) <= len(x) <= len(c) / 0.9] + [x for x in went if x != c and 0.9 * len(c) <= len(x) <= len(c) / 0.9]
        assert edits.alike([c] * len(near), near, 90).any()
    comps, _ = brute_components({r["doc_id"]: r["text"] for r in after[1]}, 5)
    assert {r["doc_id"] for r in after[2]} == {k for k, c in comps.items() if k == c}
    copies = collections.Counter(r["doc_id"] for r in after[3])
    assert set(copies) <= {r["doc_id"] for r in after[2]} and max(copies.values()) <= 2
    assert [r["decoded_sha256"] for r in sorted(after[4], key=lambda r: r["doc_id"])] == [hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in sorted(after[3], key=lambda r: r["doc_id"])]


def test_pipeline_stage_bounds():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and minhash.BANDS * minhash.ROWS == 2 * minhash.PERMUTATIONS
