"""Text-preparation operators: brute force, round trips, held-out accuracy and edge cases."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshlark.llm import _store, ann, chat_format, decontaminate, exact_dedup, mixture, near_dedup, pii, registry, token_files, toxicity, url_filter
from meshlark.llm.components import components
from meshlark.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score double, key string"


def docs_of(spark, texts, sources=None):
    """Documents with further columns whose names clash with results."""
    _store.ship(spark)
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", 0.5, "k") for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark pages conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE[name]).df()
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def covered(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("many", [50_000, 1])
def test_exact_dedup_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(exact_dedup, "MANY", many)
    r = random.Random(1)
    shared = words(80, 9)
    texts = [words(r.randint(1, 120), i) for i in range(20)] + [words(20, 50 + i) + " " + shared + " " + words(15, 80 + i) for i in range(6)] + ["x" * 650, "ab" * 300, "", None, "é" * 150, "é" * 150, shared, shared]
    got = {x["doc_id"]: tuple(x)[1:5] for x in exact_dedup.repeated_strings(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == covered([(t or "").encode() for t in texts], 200)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.repeated_strings(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_nearest_recall_ties_and_bad_vectors(spark):
    _store.ship(spark)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 32))
    x[100:110] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 32), (2100, [float("nan")] * 32), (2150, [1.0, 2.0]), (2200, []), (2250, [None] + [1.0] * 31)]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 1200, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(1200), -s))[:5]) & set(got[q]))
    assert set(got) == set(range(0, 1200, 50)) and hits / 120 >= 0.9
    assert got[0] == [100, 101, 102, 103, 104]


def test_nearest_verifies_few_rows_where_neighbours_are_close(spark):
    rng = np.random.default_rng(0)
    close = np.repeat(rng.standard_normal((100, 64)), 20, axis=0) + 0.25 * rng.standard_normal((2000, 64))
    for name, vectors, most in (("clustered", close, 0.2), ("even", rng.standard_normal((2000, 64)), 0.6)):
        index, unit = ann.ProjectionIndex(np.arange(2000), vectors, ann.PROJECTIONS), vectors / ann.norms(vectors)[:, None]
        hit = 0
        for i in range(0, 2000, 40):
            cosines = unit @ unit[i]
            cosines[i] = -2
            hit += len(set(np.argsort(-cosines)[:5].tolist()) & set(index.search(i, vectors[i], 5)[0].tolist()))
        recall, share = hit / 250, index.verified / 50 / 2000
        print(f"{name}: recall {recall:.3f}, verified {share:.3f}")
        assert recall >= 0.9 and share <= most


def test_nearest_recall_on_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    good = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows if r["embedding"] is not None and None not in r["embedding"]}
    good = {i: v for i, v in good.items() if len(v) == 64 and np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(good))
    unit = np.array([good[i] / np.sqrt((good[i] ** 2).sum()) for i in ids.tolist()])
    got = collections.defaultdict(set)
    for r in registry.QUERIES["op2_nearest"](spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for at, i in enumerate(ids.tolist()):
        if i % 50 == 0:
            cosines = unit @ unit[at]
            cosines[at] = -2
            hit, total = hit + len(set(ids[np.argsort(-cosines)[:5]].tolist()) & got[i]), total + 5
    print(f"recall {hit / total:.3f}")
    assert hit >= 0.9 * total


def test_chat_round_trip_and_parts(spark):
    _store.ship(spark)
    alphabet = ["<", "|", "\\", "<|", "|>", "im_end", "<|im_end|>", "<|im_start|>", "\n", "é", "a"]
    r = random.Random(2)
    for _ in range(3000):
        role, text = ("".join(r.choices(alphabet, k=r.randint(0, 9))) for _ in range(2))
        made, _, _, _ = chat_format.segment(role, [{"kind": "text", "text": text}])
        assert list(chat_format.parse(made + made)) == [(role, text)] * 2
    flat = chat_format.flatten([{"kind": "text", "text": "see <|image:0|>"}, {"kind": "image", "ref": "a.png", "units": 2}, {"kind": "audio", "ref": "b.wav", "units": 3}, {"kind": "document", "ref": "c.pdf"}])
    assert "".join(flat.pieces) == "see <\\|image:0|><|image:0|><|audio:1|><|document:2|>"
    assert [a["ref"] for a in flat.attachments] == ["a.png", "b.wav", "c.pdf"] and flat.expanded_tokens == 2 * 256 + 3 * 25 + 512
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, None, "assistant", "")]
    got = {x["conv_id"]: x for x in chat_format.digests(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1 and got[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c d", words(5000, 77), words(5000, 77) + " x"]
    for g in range(4):
        base = words(120, 100 + g).split()
        for _ in range(12):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(120)] = f"z{r.randrange(9999)}"
            texts.append(" ".join(t))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(80, 70), (None, 1), (5, 5)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(70, 70), (80, 70)}
    assert components(edges.limit(0)).count() == 0


def test_superminhash_estimates_and_stops_early():
    a, b = np.arange(1, 901, dtype=np.uint64), np.arange(101, 1001, dtype=np.uint64)
    values = np.concatenate([near_dedup._text.mix(a), near_dedup._text.mix(b)])
    s = near_dedup.signatures(values, np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert (s >> np.uint64(56)).max() < 5


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) if i % 2 == 0 else (2 * int(c) - 1) % 9 + 1 if c != "0" else 0 for i, c in enumerate(reversed(d))]
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and sum(twice) % 10 == 0) or (kind == "phone" and 10 <= len(d) <= 15)):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_base_and_disclosure(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("aZ0123456789....@@+--  ()_%é\U0001f600", k=r.randint(0, 120))) for _ in range(800)] + [None, "", "4111 1111 1111 1111", "a@b.c_d@e.f", "a" * 20000 + "@", "a@b" + ".c" * 5000, "x@y.z"]
    filler = len(texts)
    texts += [f"{words(8, 500 + i)} director Zarkony writes from zarko@corp.example on {words(8, 900 + i)}" for i in range(6)] + [words(30, 2000 + i) for i in range(60)]
    got = {x["doc_id"]: (x["base"], x["spans"]) for x in pii.find(docs_of(spark, texts)).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == ",".join(base_spans(t or "")), (i, t)
        assert set(filter(None, got[i][0].split(","))) <= set(got[i][1].split(","))
    told = [texts[filler][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[filler][1].split(",")) if k in ("term", "drop")]
    assert "Zarkony" in told and not any(w.startswith("w") and w[1:].isdigit() for w in told)
    clean = spark.createDataFrame([("mail x@y.zz now", [(5, 0, 11)]), (None, [])], "text string, spans array<struct<start:long,kind:int,end:long>>")
    assert [x[0] for x in clean.select(pii.sanitised(F.col("text"), "spans")).collect()] == ["mail [email] now", None]


def test_pii_secrets_and_what_reveals_them(spark):
    """Values of single texts are protected by their kind; long words and long numbers are no secrets."""
    r = random.Random(8)
    keys = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(4)]
    texts = [f"{words(20, i, 100_000)} passkey = '{k}' {words(20, 50 + i, 100_000)}" for i, k in enumerate(keys)] + [words(40, 200 + i) for i in range(80)] + ["x" * 60, "1" * 60, "passkeys"]
    got = {x["doc_id"]: x["spans"] for x in pii.find(docs_of(spark, texts)).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    for i, k in enumerate(keys):
        at, word = texts[i].index(k), texts[i].index("passkey")
        assert set(got[i].split(",")) == {f"secret:{at}:{at + 40}", f"drop:{word}:{word + 7}"}
    assert not any(got[i] for i in range(4, len(texts)))


def test_pii_runs_without_python(spark):
    plan = pii.find(docs_of(spark, ["x@y.z"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_offsets(spark):
    item = words(14, 5)
    texts = [f"Ça, {item.upper()}! end", words(40, 6), None, "", "Short"]
    bench = spark.createDataFrame([(2, item), (10, item), (3, None), (4, "short"), (5, "!!")], "item_id long, text string")
    for options in ({}, {"max_windows": 2}, {"max_windows": 1, "max_broadcast_mb": 0}):
        got = {x["doc_id"]: x for x in decontaminate.decontaminate(docs_of(spark, texts), bench, **options).collect()}
        assert (got[0]["n_words"], got[0]["n_hit"], got[0]["items"]) == (16, 14, ["10", "2"])
        h = got[0]["hits"][0]
        assert texts[0].encode()[h["byte_start"] : h["byte_end"]].decode() == item.upper()
        assert not got[1]["contaminated"] and got[2]["n_words"] == 0 and got[4]["items"] == ["4"]
    assert decontaminate.decontaminate(docs_of(spark, texts), bench.limit(0)).where("contaminated").count() == 0


def test_simple8b_and_token_files(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1023, 1025, 4000):
        for hi in (1, 2, 300, 50_000, 1 << 31):
            ids = rng.integers(0, hi, n).astype(np.uint32)
            w, at = token_files.encode_words(ids)
            assert (token_files.decode_words(w) == ids).all()
            assert all((token_files.decode_words(w[at[b] : at[b + 1]]) == ids[b * 1024 : (b + 1) * 1024]).all() for b in range(len(at) - 1))
    coder = token_files.pieces(tokenizer_path())
    r = random.Random(2)
    texts = ["".join(r.choices(list(" \n\t'sdtrevml1²9!?.é-ñA    x\u0085​日"), k=r.randint(0, 30))) for _ in range(3000)] + ["", None, "a<|endoftext|>b", "'s're 's''s", words(4000, 1)]
    want = [e.ids for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    data, offsets = token_files._text.text_buffer(pa.array(texts))
    ids, sizes = coder.encode(data, offsets)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    got = token_files.read(token_files.write(docs_of(spark, texts), tokenizer_path())).orderBy("doc_id").collect()
    start = 0
    for x, w in zip(got, want, strict=True):
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes()))
        start += len(w) + 1


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7x?q", "https://example.com/en/9", "ftp://x.example.net/de/8", "http://y.net/de/", "http://org/es/", "http://poker-bonus.example.org/x", "http://" + "a." * 5000 + "com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(5)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/7x"), ("example.com", "/en/9")]
    assert [(got[i]["verdict"], got[i]["rule"]) for i in range(3, 8)] == [("allow", "example.com/en/7"), ("block", "com/en/"), ("block", "example.net/de/8"), ("allow", "net/de/"), ("block", "org/es/")]
    assert got[8]["verdict"] == "block" and got[9]["rule"] == "com/en/"
    many = url_filter.RULES + [("block", f"h{i}.example", "/") for i in range(300)]
    joined = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filter.filter_urls(pages, rules=many).collect()}
    assert joined == {k: (r["verdict"], r["rule"]) for k, r in got.items()}
    # site names that the table doesn't have
    known = {n for found in url_filter.names(0) for n in found}
    rows = [(u, y) for turn in (13, 29) for u, y in url_filter.labelled(turn) if u and not any(f"{n}." in u.split("://")[1] for n in known if n in u)]
    held = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    said = {r["page_id"]: r["verdict"] == "block" for r in url_filter.filter_urls(held, rules=[]).collect()}
    hit = sum(said[i] for i, (_, y) in enumerate(rows) if y)
    assert len(rows) > 400 and hit >= 0.8 * sum(y for _, y in rows) and hit >= 0.8 * sum(said.values())
    usual = ["https://en.wikipedia.org/wiki/Spark", "https://github.com/x/y", "https://arxiv.org/abs/1", "https://stackoverflow.com/q/1", "https://www.nytimes.com/", "https://www.gov.uk/a", "https://docs.python.org/3/", "http://no.name/", "http://"]
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(usual)], "page_id long, url string"), rules=[]).collect()} == {"allow"}
    assert not re.search("Python|Pandas|Arrow", url_filter.filter_urls(pages)._jdf.queryExecution().toString())


def test_mixture(spark):
    r = random.Random(8)
    sources = [r.choice(["a", "b", "c", "d", None, "rare"] if i < 12 else ["a", "a", "a", "b", "c", None]) for i in range(400)]
    texts = [None if i % 90 == 0 else words(r.randint(0, 60), i) for i in range(400)]
    docs = docs_of(spark, texts, sources)
    rows = mixture.plan(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for x in rows:
        assert x["size"] == len((texts[x["doc_id"]] or "").split()) and x["taken"] <= 3 * x["size"] and len(x["positions"]) == x["copies"]
        assert all(0 <= p <= 1 for p in x["positions"])
        by[x["source"]][0] += x["size"]
        by[x["source"]][1] += x["taken"]
        by[x["source"]][2] = x["target"]
    assert abs(sum(t for _, _, t in by.values()) - sum(n for n, _, _ in by.values())) < 1e-6
    assert all(abs(k - t) <= 30 and t <= 3 * n + 1e-9 for n, k, t in by.values())
    again = {x["doc_id"]: x["taken"] for x in mixture.plan(docs.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in rows}
    assert collections.Counter(x["doc_id"] for x in mixture.mix(docs).collect()) == collections.Counter({x["doc_id"]: x["copies"] for x in rows if x["copies"]})
    assert mixture.plan(docs.limit(0)).count() == 0


def test_mixture_against_plain_python(spark):
    """Targets by bisection on the water level, order and copies by running sums, positions by bisection on the integral."""
    r = random.Random(5)
    sources = [r.choice(["a"] * 30 + ["b"] * 8 + ["c", "d", None]) for _ in range(500)]
    texts = [None if i % 80 == 0 else words(r.randint(0, 70), i) for i in range(500)]
    rows = mixture.plan(docs_of(spark, texts, sources)).collect()
    names = sorted(set(sources) - {None}) + [None]
    sizes = {s: sum(x["size"] for x in rows if x["source"] == s) for s in names}
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(3 * sizes[s], level * weight[s]) for s in names) < total else (lo, level)
    rates = [(1.0, 1.0), (1.5, 0.5), (0.5, 1.5)]

    def moment(share, a, b):
        left, right = 0.0, 1.0
        for _ in range(80):
            t = (left + right) / 2
            left, right = (t, right) if (a * t + (b - a) * t * t / 2) / ((a + b) / 2) < min(1.0, share) else (left, t)
        return left

    for i, s in enumerate(names):
        own = sorted((x for x in rows if x["source"] == s), key=lambda x: (x["print"] % 2**64, x["doc_id"]))
        target = min(3 * sizes[s], hi * weight[s])
        start, changed = 0, 0
        for x in own:
            assert abs(x["target"] - target) < 1e-3 and x["source_size"] == sizes[s]
            plain = min(3, max(0, int((target - start - x["size"] / 2) // sizes[s] + 1))) if x["size"] else 0
            changed += plain != x["copies"]
            assert abs(plain - x["copies"]) <= 1
            for e, at in enumerate(x["positions"]):
                assert abs(at - moment((start + e * sizes[s]) / target, *rates[i % 3])) < 1e-6
            start += x["size"]
        assert changed <= 4 and abs(sum(x["taken"] for x in own) - target) <= 3


def test_empty_tables(spark, tmp_path):
    """Every query gives its columns and no rows of its table."""
    import corpus_pipeline

    for name in "documents embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in registry.QUERIES.items():
        got, want = query(spark, str(tmp_path)), query(spark, DATA).schema
        assert got.schema == want and got.count() == (1 if name.startswith("op3_") else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    """Columns with the names that the operators use inside change nothing, and a repeated row gets its own answer."""
    names = "_mix_print _mix_at _mix_pos print its at position id key n label score rank words_of found items scored_text c0 c1 vector turn".split()
    text = words(40, 1)
    plain = docs_of(spark, [text, text, words(30, 2), None], ["a", "a", "b", "b"]).drop("score", "key")
    plain = plain.union(plain.where("doc_id = 2"))
    more = plain.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])
    bench = spark.createDataFrame([(1, words(12, 3))], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, toxic int")
    runs = {
        "mix": lambda d: mixture.mix(d).select("doc_id", "text"),
        "benchmark": lambda d: decontaminate.decontaminate(d, bench).select("doc_id", "n_words", "n_hit"),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)).select("doc_id", F.round("score", 9)),
        "near": lambda d: near_dedup.near_duplicates(d),
        "exact": lambda d: exact_dedup.repeated_strings(d).select("doc_id", "n_removed"),
        "pii": lambda d: pii.find(d).select("doc_id", "spans"),
    }
    for name, run in runs.items():
        a, b = (sorted(map(str, run(d).collect())) for d in (plain, more))
        assert a == b and len(a) >= 5 - (name == "mix"), name
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, text string")
    assert chat_format.digests(chat_format.format_turns(turns.withColumns({c: F.lit("x") for c in ("segment", "part", "n", "key")}))).collect() == chat_format.digests(chat_format.format_turns(turns)).collect()
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    near = lambda v: sorted(map(str, ann.nearest(v, F.col("vec_id") % 50 == 0).collect()))
    assert near(vectors) == near(vectors.withColumns({c: F.lit(1) for c in ("id", "vector", "asked", "shard", "block", "rank", "score")}))


def test_very_long_texts_need_little_memory():
    """A text of 20 MB goes through each worker function in well under a gigabyte."""
    script = """
import resource, sys
import numpy as np, pyarrow as pa
from meshlark.llm import _text, exact_dedup, near_dedup, toxicity, decontaminate, token_files
from meshlark.llm.queries import tokenizer_path
text = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 500_000, 2_700_000))
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"])
data, offsets = _text.text_buffer(batch.column(1))
what = sys.argv[1]
if what == "exact":
    for _ in exact_dedup._runs(200, 32)(iter([pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], names=["key", "text"])])): pass
if what == "near": list(near_dedup._sketch(iter([batch])))
if what == "terms": list(toxicity.term_counts(batch.column(1), np.sort(np.arange(1000, dtype=np.uint64))))
if what == "tokens":
    ids, _ = token_files.pieces(tokenizer_path()).encode_long(data)
    words, _ = token_files.encode_words(ids)
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    for what in ("exact", "near", "terms", "tokens"):
        out = subprocess.run([sys.executable, "-c", script, what], capture_output=True, text=True, env=os.environ, check=True).stdout.split()
        assert int(out[0]) > 15_000_000 and int(out[1]) < 1000, (what, out)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    for n, common in ((500, 0.25), (500, 0.0), (64, 2.0), (7, 0.25)):
        dense = np.zeros((n, 40))
        for i in range(n):
            t = rng.choice(40, rng.integers(1, 8), replace=False)
            dense[i, t] = rng.random(len(t))
            dense[i] /= np.sqrt((dense[i] ** 2).sum())
        owner, term = np.nonzero(dense)
        index = toxicity.BlockMaxIndex(owner, term, dense[owner, term], n, 40, block=16, common=common)
        for _ in range(100):
            t = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
            w = rng.random(len(t))
            w /= np.sqrt((w * w).sum())
            c = np.round(dense[:, t] @ w, 12)
            want = np.lexsort((np.arange(n), -c))[:15]
            ids, cosines = index.nearest(t, w, 15)
            assert ids.tolist() == want[c[want] > 0].tolist() and np.allclose(cosines, c[ids])


def test_toxicity_scores_against_brute_force(spark):
    """Every score of the operator, from dictionaries of words and plain cosines with all examples."""
    r = random.Random(5)
    texts = [" ".join([words(30, i)] + [r.choice(["vile", "scum", "rotten"]) for _ in range(2 * (i % 4 == 0))]) for i in range(160)] + ["W1 w1 w2", None, "", "unseen only"]
    labels = {i: int(i % 4 == 0) for i in range(0, 160, 2)} | {1: 0, 3: 0}
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    bags = [collections.Counter((t or "").lower().split()) for t in texts]
    df = collections.Counter(w for b in bags for w in b)
    examples = list(labels)
    held, bad = collections.Counter(w for i in examples for w in bags[i]), collections.Counter(w for i in examples if labels[i] for w in bags[i])
    rate = sum(labels.values()) / len(labels)

    def weight(w):
        a, n = bad[w], held[w]
        share, evidence = a / n, 0.0
        if share > rate:
            evidence = a * np.log(share / rate) + ((n - a) * np.log((1 - share) / (1 - rate)) if n > a else 0)
        return (np.log((1 + len(texts)) / (1 + df[w])) + 0.01) * (0.05 + np.log1p(max(0.0, evidence - 4)))

    def vector(b):
        v = {w: (1 + np.log(n)) * weight(w) for w, n in b.items() if w in held}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    known = {i: vector(bags[i]) for i in examples}
    for i, b in enumerate(bags):
        v = vector(b)
        near = sorted((-round(sum(x * known[j].get(w, 0) for w, x in v.items()), 12), labels[j]) for j in examples)[:25] if v else []
        assert len({c for c, _ in near}) >= len([c for c, _ in near if c]) - 2  # hardly a tie
        votes, every = sum(-c * y for c, y in near), sum(-c for c, _ in near)
        assert abs(got[i]["score"] - ((votes + 0.1 * rate) / (every + 0.1) if v else rate)) < 1e-6, i
    assert {x["predicted"] for i, x in got.items() if i < 160 and i % 4 == 0} == {1}


def test_toxicity_scores_are_calibrated_on_held_out_rows(spark):
    """Of the held-out rows in each tenth of the score, about that share is toxic."""
    rows = registry.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("held_out").collect()
    low, high = [x["toxic"] for x in rows if x["score"] < 0.3], [x["toxic"] for x in rows if x["score"] >= 0.7]
    assert len(rows) > 100 and sum(low) <= 0.1 * len(low) and sum(high) >= 0.7 * len(high) and sum(high) >= 0.75 * sum(x["toxic"] for x in rows)


def test_toxicity_held_out_and_empty(spark):
    r = random.Random(9)
    bad = ["vile", "scum", "rotten"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        t = words(40, i).split()
        if toxic:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    texts += [None, "", "!!"]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(labels + [(7, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table, train=F.col("doc_id") % 3 != 1)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert all((got[i]["score"] >= 0.7) == bool(labels[i][1]) for i in held)
    assert all(0 <= got[i]["score"] < 0.3 for i in (600, 601, 602)) and got[0]["evidence"][0]["label"] == 1
    few = toxicity.fit(docs, table, max_postings=2000)
    assert 40 <= len(few.labels) <= 60
    assert [x["score"] for x in toxicity.score(docs, toxicity.fit(docs, table.limit(0))).limit(3).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    copy = words(60, 1)
    item = words(12, 2)
    texts = [copy, copy, copy + " tail", f"{words(30, 3)} {item}", None, ""] + [words(50, 10 + i) for i in range(10)]
    docs_of(spark, texts, ["a" if i % 2 else "b" for i in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = collections.Counter(x["doc_id"] for x in got)
    assert not {1, 2, 3} & set(ids) and max(ids.values()) <= 3
    want = {i: [*e.ids, 2] for i, e in enumerate(token_files.pieces(tokenizer_path()).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert all(x["ids_crc32"] == zlib.crc32(np.array(want[x["doc_id"]], "<u4").tobytes()) for x in got)
    total = sum(len((texts[i] or "").split()) for i in range(len(texts)) if i not in (1, 2, 3))
    assert abs(sum(n * len((texts[i] or "").split()) for i, n in ids.items()) - total) <= 120
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).columns == [x.split()[0] for x in DOCS.split(", ")]


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(104)]  # 100 shingles
    one = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(base))
    texts = [one(), one(20, 21, 22, 23, 24), one(20, 24, 29)]  # nine and fourteen shingles changed: 91 / 109 and 86 / 114
    sets = [shingle_set(t) for t in texts]
    shared = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert 0.8 <= shared[1] < 0.85 and shared[2] < 0.8 and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.8
    docs = docs_of(spark, texts)
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicate(spark, docs, "").collect()} == {0, 2}
    assert all(x["kept"] for x in near_dedup.near_duplicates(docs).collect())


def test_pipeline_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    _store.ship(spark)
    copy, other = words(60, 1), words(60, 2)
    rows = [(1, copy), (1, copy), (2, copy + " tail"), (2, other), (3, other), (4, None), (4, None), (4, ""), (None, copy), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", float(n), "k") for n, (i, t) in enumerate(rows)], DOCS)
    got = corpus_pipeline.near_duplicate(spark, docs, "").collect()
    assert collections.Counter((x["doc_id"], x["text"]) for x in got) == collections.Counter([(1, copy), (2, other), (4, None), (4, ""), (None, copy), (None, "")])
    assert {x["score"] for x in got} == {0.0, 3.0, 5.0, 7.0, 8.0, 9.0}


def test_pii_terms_over_whole_texts(spark):
    far = words(60, 1)
    texts = [f"ask ann@corp.example {words(60, 10 + i)} at Quillby Xy, QUILLBY and {'Unrelated' if i else 'Lonely'}" for i in range(2)]
    texts += [texts[0], texts[0], "bob@solo.example writes Hapaxo", "bob@solo.example writes Hapaxo", "Quillby without an address"]
    texts += [f"{words(40, 100 + i)} {far}" for i in range(60)] + [words(3000, 7, 5) + " " + texts[1]]
    got = {x["doc_id"]: x["spans"] for x in pii.find(docs_of(spark, texts)).select("doc_id", pii.listed("spans").alias("spans")).collect()}
    told = lambda i: [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in filter(None, got[i].split(","))) if k in ("term", "drop")]
    # words stand 60 words from the address, twice; short ones count; copies don't, and one text proves nothing
    for i in (0, 1, 2, 3, len(texts) - 1):
        assert [w for w in told(i) if w.lower() in ("quillby", "xy")] == ["Quillby", "Xy", "QUILLBY"], i
        assert "Lonely" not in told(i) and "corp" not in told(i)
    assert told(4) == told(5) == told(6) == []
    # counts and disclosure by brute force
    plain = {t: {w for w in re.findall(r"[A-Za-z0-9]+", re.sub(r"\S+@\S+", " ", t.lower())) if not w.isdigit()} for t in texts}
    n, want = len(plain), set()
    for own in ([t for t in plain if "ann@corp.example" in t], [t for t in plain if "@" in t]):  # the value, and its kind
        n_e = len(own)
        for w in set().union(*(plain[t] for t in own)):
            both, n_t = sum(w in plain[t] for t in own), sum(w in x for x in plain.values())
            if both >= max(2, n_e / 2) and np.log2(both / n_e * n / n_t) / np.log2(n / n_e) >= 0.6:
                want.add(w)
    assert {w.lower() for i in (0, 1, len(texts) - 1) for w in told(i)} == want


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_url_model_is_not_trained_on_judged_hosts(table):
    names = {h[0] for h in duckdb.sql(f"select distinct regexp_extract(url, '://(?:(?:www|m|blog)[.])?([^./?#]*)', 1) from '/root/testdata/{table}/pages.parquet'").fetchall()}
    assert len(names) > 20 and not names & {n for found in url_filter.names(0) for n in found} and not {p for n in names for p in n.split('-')} & set(url_filter.TELLING + url_filter.PLAIN)
