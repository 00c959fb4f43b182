"""Every operator against a brute-force version, on a fixture with the awkward cases, and on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare
from tidemark.llm import chat_format, decontaminate, kernel, ngram_join, oracles, quality, queries, source_mix, storage, substring_dedup, token_count, topk_search, toxicity, url_filter
from tidemark.llm.components import connected
from tidemark.llm.fm_index import FMIndex

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
WORDS = "the of and to in sea stone river light wind north south east west tree bird fish road hill lake".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def awkward():
    """(doc_id, text): nulls, blanks, short and long texts, copies, near copies, shared passages, odd white space."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [None, "", " \t\n", "one", "One two", "one  TWO", "a b c", "\x1cx\x85 y\u2003z", "ß É é", base, base, base.upper(), base.replace(" ", "\n")]
    texts += [edited(rng, base, k) for k in (1, 1, 2, 3, 5, 8, 13, 40)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, k) for k in (0, 5, 30)]
    texts += [passage[: len(passage) // 2], prose(rng, 3000), "of " * 200, "x" * 5000, prose(rng, 34), prose(rng, 35)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward texts under columns whose names operators use inside."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en" if i % 5 else None, i, i, "r", 1.0) for i, t in awkward()]
    rows.append((None, "a null id has words too", "s1", "en", None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, id long, n long, row string, spans double").cache()


def tokens(text):
    return [w for w in SPLIT.findall((text or "").encode())]


# --- storage -------------------------------------------------------------------------------------------------


def test_written_tables_need_no_checksum_files(spark):
    """Each file more is a process more that an executor starts; pages carry checksums of their own, and a damaged one is found."""
    rows = [(i, f"{i:032x}") for i in range(5000)]
    df = storage.written(spark.createDataFrame(rows, "i long, x string").coalesce(1), "plain")
    folder = Path(df.inputFiles()[0].removeprefix("file:")).parent
    assert not list(folder.glob(".*.crc"))
    assert sorted(map(tuple, df.collect())) == rows
    (part,) = folder.glob("part-*")
    data = bytearray(part.read_bytes())
    column = pq.ParquetFile(part).metadata.row_group(0).column(0)
    data[(column.dictionary_page_offset or column.data_page_offset) + column.total_compressed_size - 5] ^= 1
    part.write_bytes(data)
    with pytest.raises(Exception, match="CRC"):
        df.collect()
    storage.discard(df)


# --- kernel --------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = [t for _, t in awkward()]
    names = {}
    for words in kernel.slices(pa.array(texts)):
        for k, row in enumerate(words.rows):
            a, b = words.first[k], words.first[k + 1]
            found = [words.raw[x:y] for x, y in zip(words.start[a:b], words.end[a:b])]
            assert found == tokens(texts[row])
            for w, h in zip(found, words.hash[a:b].tolist()):
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(0)
    for sigma in (1, 2, 4, 50):
        text = rng.integers(1, sigma + 1, 300)
        text[[40, 41, 150, 299]] = 0
        n = 4
        starts = np.array([i for i in range(len(text) - n + 1) if 0 not in text[i : i + n]])
        count = Counter(tuple(text[i : i + n]) for i in starts)
        for s, f in zip(starts, FMIndex(text, n).repeated(text, starts, n)):
            assert (f < 0) == (count[tuple(text[s : s + n])] > 1)
            if f >= 0:
                tail = tuple(text[s + f : s + n])
                assert sum(tuple(text[i : i + len(tail)]) == tail for i in range(len(text))) == 1


# --- 1 url filter ----------------------------------------------------------------------------------------------


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in queries.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "HTTP://A.Example.ORG/es/x?y", "https://example.org/en/12#a", "http://xexample.org/es/", "http://shop.com/fr/a", "http://com/de/", "a://b://c/d", "http://e.net?x/y", "http://É.org/a\nb", "http://e.net/" + "q" * 3000, "http://" + "ab" * 40000 + ".net/"]


def test_url_rules_and_verdicts(spark):
    rows = [(i, u, None if i % 3 else "<p>blue stone river</p>", "h") for i, u in enumerate(URLS + URLS[:2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, queries.RULES).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (("allow" if queries.RULES[rule] else "block") if rule else got[i]["verdict"])
    assert url_filter.filter_urls(df.limit(0), queries.RULES).count() == 0


def test_host_names_are_split_like_the_best_split():
    counts = Counter({"blue": 50, "stone": 40, "blues": 5, "tone": 5, "river": 30, "a": 9})
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in counts], np.uint64)
    seg = url_filter.Segmenter(url_filter.ExactCounts(hashes, np.array(list(counts.values())), sum(counts.values())))
    for name in ("bluestone", "riverbluestone", "zzblue", "a", "bluestonetone"):
        cuts = (c for n in range(len(name)) for c in itertools.combinations(range(1, len(name)), n))
        best = min(sum(seg.cost(name[a:b]) for a, b in zip((0, *c), (*c, len(name)))) for c in cuts)
        assert sum(map(seg.cost, seg.split(name))) == pytest.approx(best)
    assert seg.split("bluestone") == ("blue", "stone")
    assert "".join(seg.split("bluestone" * 2000)) == "bluestone" * 2000


def test_verdicts_by_brute_force(spark):
    """Every verdict of the method from counts made here: words of the running text, segmentation by all splits, naive Bayes."""
    rng = random.Random(8)
    words = ["sea", "blue", "mud", "stone", "hill"]
    name = lambda some: "".join(rng.choice(some) for _ in range(rng.choice([1, 2])))
    kinds = [("org", "x9/", words[:2]), ("com", "de/", words[2:]), ("com", "de/1", words[2:]), ("net", "fr/", words[:2]), ("net", "es/", words[2:]), ("example.org", "es/", words)]
    urls = [f"http://{name(some)}.{top}/{at}{name(some)}" for top, at, some in (rng.choice(kinds) for _ in range(120))] + [None, "http://", "http://x.zz"]
    html = ["<p>" + " ".join(rng.choice(words) for _ in range(9)) + "</p>" for _ in urls]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html))] + [(None, urls[0], None)], "page_id long, url string, html string")
    rows = [(*brute_url(u), h) for u, h in zip(urls, html)] + [(*brute_url(urls[0]), "")]
    count = Counter(w for h_, p, _, h in rows for w in re.findall("[a-z]+", p.lower()) + re.findall("[a-z]+", h.replace("<p>", " ").replace("</p>", " ")))
    total = sum(count.values())
    cost = lambda w: math.log(total) - math.log(count[w]) if count[w] else math.log(total) + 3.0 * len(w)

    def split(name):
        cuts = [(0, *c, len(name)) for n in range(min(len(name), 4)) for c in itertools.combinations(range(1, len(name)), n)]
        return min(([name[a:b] for a, b in itertools.pairwise(c)] for c in cuts), key=lambda x: sum(map(cost, x)))

    def tokens_of(h, p):
        labels = h.split(".") if h else []
        out = [f"d:{labels[-1]}"] if labels else []
        out += [f"h:{w}" for label in labels[:-1] for w in split(label)]
        return out + [t for run in re.findall("[a-z]+|[0-9]+", p) for t in ([f"p:#{len(run)}"] if run.isdigit() else [f"p:{w}" for w in split(run)])]

    seen = {True: Counter(), False: Counter()}
    n = Counter()
    for h, p, rule, _ in rows:
        if rule:
            seen[queries.RULES[rule]].update(url_filter.cell(t) for t in tokens_of(h, p))
            n[queries.RULES[rule]] += 1
    size = {k: url_filter.CELLS + sum(c.values()) for k, c in seen.items()}
    odds = lambda h, p: math.log((n[True] + 1) / (n[False] + 1)) + sum(math.log((1 + seen[True][url_filter.cell(t)]) / size[True]) - math.log((1 + seen[False][url_filter.cell(t)]) / size[False]) for t in tokens_of(h, p))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, queries.RULES).collect()}
    verdicts = Counter()
    for i, (h, p, rule, _) in zip([*range(len(urls)), None], rows):
        assert got[i]["odds"] == pytest.approx(odds(h, p))
        expected = queries.RULES[rule] if rule else odds(h, p) >= 0
        assert got[i]["verdict"] == ("allow" if expected else "block")
        verdicts[bool(rule), expected] += 1
    assert min(verdicts[False, True], verdicts[False, False]) > 3


def test_names_split_beside_a_million_words(spark):
    """A string that is no word stays unseen however many words there are."""
    word = lambda i: F.concat(F.lit("z"), F.translate(i.cast("string"), "0123456789", "abcdefghij"))
    many = F.array_join(F.transform(F.sequence(F.col("page_id") * 1000, F.col("page_id") * 1000 + 999), word), " ")
    html = F.when(F.col("page_id") < 60, F.concat(many, F.lit(" blue stone"))).otherwise(many)
    df = spark.range(1100).select(F.col("id").alias("page_id"), F.lit("http://bluestone.net/").alias("url"), F.lit(None).alias("x")).withColumn("html", html)
    assert {r["host_words"] for r in url_filter.filter_urls(df, queries.RULES).select("host_words").distinct().collect()} == {"blue stone"}


def test_words_beyond_the_vocabulary(spark, monkeypatch):
    """However few words are sent to the tasks, names are split by the counts of all words."""
    rng = random.Random(14)
    words = list({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    name = lambda: "".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    urls = [f"http://www.{name()}{rng.choice(['', '7', '-x.'])}{name()}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['fr', 'de', 'X1'])}/{name()}{rng.choice(['', '/', '22'])}{name()}?q" for _ in range(150)]
    urls += [None, "", "http://", "http://x.zz", urls[0], urls[0], "http://" + "".join(rng.choice(words) for _ in range(4000)) + ".net/de/a"]
    html = [" ".join(rng.choices(words, range(1, len(words) + 1), k=8)) for _ in urls]
    df = spark.createDataFrame([*enumerate(urls), (None, urls[1])], "page_id long, url string").withColumn("html", F.element_at(F.array(*map(F.lit, html)), (F.coalesce("page_id", F.lit(0)) + 1).cast("int")))
    letters = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    count = Counter(w for u, h in zip([*urls, urls[1]], [*html, html[0]]) for w in letters(brute_url(u)[1]) + letters(h))
    total = sum(count.values())
    cost = lambda w: math.log(total) - math.log(count[w]) if count[w] else math.log(total) + 3.0 * len(w)

    def least(name):
        best = [0.0]
        for e in range(1, len(name) + 1):
            best.append(min(best[s] + cost(name[s:e]) for s in range(max(0, e - 24), e)))
        return best[-1]

    run = lambda: sorted(map(tuple, url_filter.filter_urls(df, queries.RULES).collect()), key=str)
    whole, sent = run(), []
    seen = url_filter.ExactCounts.__init__
    monkeypatch.setattr(url_filter.ExactCounts, "__init__", lambda self, hashes, n, total: (sent.append(len(hashes)), seen(self, hashes, n, total))[0])
    for bound in (0, 20, 60):
        monkeypatch.setattr(url_filter, "VOCABULARY", bound)
        assert run() == whole
        assert min(bound, 1) <= sent.pop() <= bound
    for _, host, _, _, _, _, shown in whole:
        names = [x for label in host.split(".")[:-1] for x in re.findall(r"[^\W\d_]+|\d+", label)]
        assert shown.replace(" ", "") == "".join(names)
        assert sum(map(cost, shown.split())) == pytest.approx(sum(map(least, names)))


def test_naive_bayes_counts(spark):
    """The odds are those of a multinomial model over hashed tokens of the rule-decided URLs."""
    urls = ["http://good.org/river"] * 3 + ["http://bad.com/de/mud", "http://x.net/river", "http://x.net/mud"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("river mud good bad"))
    got = {r["page_id"]: r["odds"] for r in url_filter.filter_urls(df, queries.RULES).collect()}
    # allow: org, good, river (3 each); block: com, bad, de, mud.
    weight = lambda a, b: math.log((1 + a) / (url_filter.CELLS + 9)) - math.log((1 + b) / (url_filter.CELLS + 4))
    prior = math.log(4 / 2)
    assert got[4] == pytest.approx(prior + 2 * weight(0, 0) + weight(3, 0))
    assert got[5] == pytest.approx(prior + 2 * weight(0, 0) + weight(0, 1))


# --- 2 decontamination -------------------------------------------------------------------------------------------


def test_overlaps_with_substitutions(spark):
    rng = random.Random(1)
    items = [prose(rng, 30), prose(rng, 40), prose(rng, 6), None, "", "tiny item"]
    clean = [prose(rng, 200), None, "", "of " * 60]
    held = lambda t: prose(rng, 25) + " " + t + " " + prose(rng, 10)
    leaks = [held(items[0]), held(items[0].upper()), held(items[0].replace(" ", "!!\n")), held(edited(rng, items[1], 4)), items[2], held(" ".join(items[1].split()[:20]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + leaks)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_overlaps(df, bench).collect()}
    assert set(found) == {(4, 0), (5, 0), (6, 0), (7, 1), (8, 2), (9, 1)}
    assert (found[4, 0]["start"], found[4, 0]["end"], found[4, 0]["equal_words"]) == (25, 55, 30)
    assert found[7, 1]["equal_words"] >= 30
    kept = decontaminate.drop_contaminated(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == df.columns
    assert decontaminate.find_overlaps(df.limit(0), bench).count() == 0
    assert decontaminate.find_overlaps(df, bench.limit(0)).count() == 0


def test_longest_stretch_by_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(400):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.0, 0.3, 0.6, 0.8, 0.95])
        fits = [j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and 5 * same[i:j].sum() >= 4 * (j - i)]
        a, b = decontaminate.longest(same)
        assert b - a == max(fits, default=0)
        for a, b in decontaminate.stretches(same, 13):
            assert b - a >= 13 and 5 * same[a:b].sum() >= 4 * (b - a)
        assert bool(decontaminate.stretches(same, 13)) == (max(fits, default=0) >= 13)


def test_every_stretch_is_reported(spark):
    """Two passages of one item in one document are two rows, a passage kept and taken twice too; a loop of words is one."""
    rng = random.Random(2)
    item = prose(rng, 80).split()
    gap = lambda n: prose(rng, n).split()
    texts = [item[:20] + gap(15) + item[50:70], item[10:30] + gap(9) + item[10:30], ["of"] * 3000, gap(50), ["and", "the"] * 40 + item[60:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "of " * 40), (None, "and the " * 12)], "item_id long, text string")
    rows = [tuple(r) for r in decontaminate.find_overlaps(df, bench).collect()]
    assert {r for r in rows if r[0] in (0, 1)} == {(0, 0, 0, 20, 0, 20), (0, 0, 35, 55, 50, 20), (1, 0, 0, 20, 10, 20), (1, 0, 29, 49, 10, 20)}
    assert {r[:2] for r in rows} == {(0, 0), (1, 0), (2, 1), (4, 0), (4, None), (None, 0)}
    loops = sorted(r[2:4] for r in rows if r[0] == 2)
    assert all(b <= c for (_, b), (c, _) in itertools.pairwise(loops)) and sum(b - a for a, b in loops) >= 2900


@pytest.mark.parametrize("size, replaced, least", [(13, 0, 1.0), (13, 1, 0.75), (15, 2, 0.8), (20, 2, 0.97), (20, 4, 0.9), (25, 5, 0.95), (30, 4, 0.97), (60, 9, 0.97)])
def test_recall_of_substituted_passages(size, replaced, least):
    """Share of passages found among random words after replacing so many words at random places, measured."""
    rng = np.random.default_rng(size * 100 + replaced)
    word = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    found = 0
    for _ in range(200):
        item = word(size + 20)
        part = item[10 : 10 + size].copy()
        part[rng.choice(size, replaced, replace=False)] = word(replaced)
        hash_ = np.concatenate([word(40), part, word(40)])
        words = kernel.Words(range(1), np.empty(0, np.uint8), np.empty(0, int), np.empty(0, int), hash_, np.array([0, len(hash_)]))
        found += bool(decontaminate.Benchmark([item]).overlaps(words))
    assert found / 200 >= least


def test_seeds_find_what_brute_force_finds(spark):
    """On the tables: documents that hold a benchmark item's words in a row, and no others."""
    clean = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) + " "
    bench = [clean(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = {r["doc_id"] for r in rows if any(b in clean(r["text"]) for b in bench)}
    got = {r["doc_id"] for r in queries.op2_decontamination(spark, SF).collect()}
    assert expected <= got and len(got - expected) <= 1


# --- 3 token counts ------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert token_count.splits_at_spaces(sp)
    texts = [t for _, t in awkward()] + [" ", "  ", "a ", "a  ", " a", "  a  b  ", "▁a ▁", "a▁b", " \n ", "<s> </s> <unk>", " " * 40 + "a", "a\u0000b"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_count.count_tokens(df, model).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(sp.encode(t or ""))), repr(t)
    assert token_count.count_tokens(docs, model).where("doc_id is null").count() == 1
    assert token_count.count_tokens(df.limit(0), model).count() == 0
    again = token_count.count_tokens(df.select(F.lit(1).alias("doc_id"), "text").repartition(3), model)
    assert Counter(r["n_tokens"] for r in again.collect()) == Counter(r["n_tokens"] for r in got.values())


@pytest.mark.parametrize("heavy", [8, 700])
def test_few_heavy_pre_tokens(spark, monkeypatch, heavy):
    """Whatever is broadcast and however long pre-tokens are, counts stay the same."""
    import sentencepiece

    rng = random.Random(heavy)
    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [prose(rng, rng.randrange(400)) + " the" * rng.randrange(50) + rng.choice([" ", "  ", " " + "long" * 30]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(token_count, "HEAVY", heavy)
    known = token_count.heavy_pieces(df, model)
    count = Counter(p for t in texts for p in token_count.pre_tokens(t))
    often = {token_count.brief(p) for p, n in count.items() if n >= 2 * sum(count.values()) / heavy}
    assert often <= known.keys() and len(known) <= heavy
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, model).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_token_counts_of_the_tables(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=queries.tokenizer_file("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(sp.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)


# --- 4 substring dedup -----------------------------------------------------------------------------------------------


def brute_dedup(rows, length):
    count = Counter()
    for _, t in rows:
        w = tokens(t)
        count.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = tokens(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, hot", [(35, substring_dedup.HOT), (12, substring_dedup.HOT), (12, 1)])
def test_removed_words(spark, docs, monkeypatch, length, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = substring_dedup.remove_repeats(docs, length=length, gram=5)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_dedup(rows, length)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (1, a), (2, b + " tail"), (None, None)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_dedup(rows, 35)


def test_digests_in_files_of_their_own_size(spark, tmp_path):
    """The result's files follow the size of the digests, not that of the texts they were made from."""
    rng = random.Random(4)
    spark.createDataFrame([(i, prose(rng, 20_000)) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        queries.op4_substring_dedup(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("out/part-*"))) == 1
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


# --- 5 quality ---------------------------------------------------------------------------------------------------------


def test_site_posteriors(spark):
    """With given evidence the posterior is the beta-binomial formula, leave-one-out."""
    rng = random.Random(7)
    good = [prose(rng, 60) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rng, 40).split()) for _ in range(30)]
    rows = [(i, t, "bad" if i % 2 and t in junk else "fine", "en") for i, t in enumerate(good + junk)] + [(99, None, None, None), (98, "", "fine", None), (97, "x " * 9, "lone", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90)] + [(99, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    assert sum(out[i]["keep"] for i in range(60)) >= 59 and sum(out[i]["keep"] for i in range(60, 90)) <= 1
    bad = next(r["site_rate"] for i, r in out.items() if i < 90 and rows[i][2] == "bad")
    fine = out[0]["site_rate"]
    assert bad < fine
    assert quality.classify(df, labels.limit(0)).count() == len(rows)
    assert quality.classify(df.limit(0), labels).count() == 0


def test_posterior_by_formula(spark):
    """Site rates and scores from the reported evidence, by the beta-binomial formulas over plain lists."""
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.choice([5, 40, 200])) if rng.random() < 0.6 else "!! " * 30, rng.choice(["s1", "s1", "s2", None]), rng.choice(["en", "de", None])) for i in range(150)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, p double")
    good = {i: int(rows[i][1][0] != "!") for i in range(0, 150, 2)}
    out = {r["doc_id"]: r for r in quality.classify(df, spark.createDataFrame(list(good.items()), "doc_id long, quality int")).collect()}
    share = sum(good.values()) / len(good)
    p = {i: 1 / (1 + math.exp(-(r["evidence"] + math.log(share / (1 - share))))) for i, r in out.items()}
    host, path = defaultdict(list), defaultdict(list)
    for i, _, h, l in rows:
        host[h].append(p[i])
        path[h, l].append(p[i])
    overall = sum(p.values()) / len(p)

    def worth(groups):  # (rate, prior, n): documents that a prior is worth, by the method of moments
        n = sum(g[2] for g in groups)
        v = sum(g[2] * g[1] * (1 - g[1]) for g in groups) / n
        tau = max(0.0, (sum(g[2] * (g[0] - g[1]) ** 2 for g in groups) - len(groups) * v) / n)
        return min(1e6, max(1.0, v / tau - 1)) if tau else 1e6

    at_host = worth([(sum(x) / len(x), overall, len(x)) for x in host.values()])
    rate = {h: (sum(x) + at_host * overall) / (len(x) + at_host) for h, x in host.items()}
    at_path = worth([(sum(x) / len(x), rate[h], len(x)) for (h, _), x in path.items()])
    for i, _, h, l in rows:
        site = (sum(path[h, l]) - p[i] + at_path * rate[h]) / (len(path[h, l]) - 1 + at_path)
        assert out[i]["site_rate"] == pytest.approx(site)
        bounded = min(1 - 1e-4, max(1e-4, site))
        assert out[i]["score"] == pytest.approx(1 / (1 + math.exp(-(out[i]["evidence"] + math.log(bounded / (1 - bounded))))))
        assert out[i]["keep"] == (out[i]["score"] >= 0.5)


def test_quality_of_labels_not_fitted_on(spark):
    """Balanced accuracy on the half of the labels that the fit has not seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    out = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rates = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert (rates[1] + 1 - rates[0]) / 2 >= 0.9


def test_strength_grows_as_groups_agree(spark):
    rate = lambda rows: quality.strength(spark.createDataFrame(rows, "rate double, prior double, n long"), "rate", "prior", "n")
    apart, together = rate([(0.1, 0.5, 100), (0.9, 0.5, 100)]), rate([(0.45, 0.5, 100), (0.55, 0.5, 100)])
    assert apart < 5 < together


# --- 6 chat formatting ----------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = ["", "\\", "\\b\\l", "### user:\n", "</turn>\n<next/>", "a\nb", "é😀", None, "\\### Assistant: </turn> ok"]
    roles = ["user", "assistant", "assistant", "system", "ro:le\n", None, "user", "user", "assistant"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(roles, tricky))] + [(2, 0, "assistant", "only", "x"), (None, None, "user", "n", "x"), (3, 1, "user", "b", "x"), (3, 1, "user", "a", "x"), (3, None, "assistant", "z", "x"), (3, 1, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_conversations(df)
    out = out.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [t[2:] for t in turns]
        assert got[conv]["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")
        blocks = sum(1 for i, t in enumerate(turns) if not i or turns[i - 1][2] != t[2])
        assert got[conv]["formatted"].count("</turn>\n") == blocks
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_digests(spark):
    compare(spark, queries.op6_chat_formatting, oracles.OP6, SF)
    row = queries.op6_chat_formatting(spark, SF).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() and row["loss_chars"] == len(text)


# --- 7 top-k -----------------------------------------------------------------------------------------------------------------


def brute_topk(rows, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 10 ** rng.choice([-2, 0, 1])) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(12)] + [(720, None), (721, [1.0, None]), (722, [math.nan] * 6), (723, [math.inf] * 6), (724, []), (725, [2.0]), (None, [1.0] * 6), (730, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute_topk(rows, 5)
    few = df.where("vec_id in (0, 1, 2)")
    assert topk_search.top_k(few, F.col("vec_id") % 5 == 0).count() == 2
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_coordinate_pruning_keeps_every_hit():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 200, 12)
    vectors = (centre + rng.normal(0, 8, (600, 12))).astype(np.int64)
    q = vectors[:40]
    best = topk_search.Best(40, 5)
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-lengths)
    ids, v, lengths = np.arange(600)[order], vectors[order], lengths[order]
    for a in range(0, 600, 50):
        topk_search.search_bucket(q, np.arange(40), v[a : a + 50], ids[a : a + 50], lengths[a : a + 50], best)
    scores = q @ vectors.T
    for i in range(40):
        expected = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert sorted((-int(s), int(j)) for s, j in zip(best.score[best.q == i], best.id[best.q == i])) == expected


@pytest.mark.parametrize("spread, close", [(True, False), (False, True), (False, False)])
def test_share_of_products_that_is_spared(spread, close):
    """Spread lengths are pruned by length, close neighbours by coordinates; neither leaves every product to compute. Always the same hits."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (6000, 32))
    if close:
        v = np.repeat(v[:500], 12, axis=0) + rng.normal(0, 0.02, v.shape)
    v *= (256 * np.exp(rng.normal(0, 1, 6000)) if spread else np.full(6000, 256.0))[:, None] / np.linalg.norm(v, axis=1)[:, None]
    v = np.floor(v).astype(np.int64)
    lengths = topk_search.norms(v)
    order = np.argsort(-lengths)
    ids, v, lengths = np.arange(6000)[order], v[order], lengths[order]
    q, q_ids = v[::60], ids[::60]
    best = topk_search.Best(len(q), 5, topk_search.reached(q, q_ids, v[:1024], ids[:1024], 5))
    for a in range(0, 6000, topk_search.BUCKET):
        topk_search.search_bucket(q, q_ids, v[a : a + topk_search.BUCKET], ids[a : a + topk_search.BUCKET], lengths[a : a + topk_search.BUCKET], best)
    scores = q @ v.T
    for i in range(len(q)):
        expected = sorted((-int(s), int(j)) for s, j in zip(scores[i], ids) if j != q_ids[i])[:5]
        assert sorted((-int(s), int(j)) for s, j in zip(best.score[best.q == i], best.id[best.q == i])) == expected
    spared = 1 - best.products / best.pairs
    assert spared > (0.7 if spread else 0.3) if spread or close else spared < 0.1, spared


def test_scores_saturate(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0]), (3, [1e12, 1.0]), (4, [3e8, 1.0]), (5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk_search.top_k(df, F.lit(True), k=5).collect()}
    v = {i: [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in row] for i, row in rows}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == {(i, j): clip(sum(a * b for a, b in zip(v[i], v[j]))) for i in v for j in v if i != j}


def test_topk_of_the_tables(spark):
    compare(spark, queries.op7_exact_topk, oracles.OP7, SF)


# --- 8 source mix ---------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * share > 2 * sizes[n]]
        if not over:
            return target | {n: weight[n] * share for n in open_}
        for n in over:
            target[n] = 2.0 * sizes[n]
            left -= target[n]
            open_.remove(n)
    return target


def check_mix(rows, got, near=0.02):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(tokens(r["text"]))
    target, taken = brute_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    smallest = {n: min([len(tokens(r["text"])) for r in rows if r["source"] == n and tokens(r["text"])], default=0) for n in sizes}
    for n in sizes:
        assert abs(taken[n] - target[n]) <= near * target[n] + smallest[n]


def test_mix_of_awkward_documents(spark, docs):
    got = source_mix.balance(docs).collect()
    check_mix(docs.collect(), got, near=0.6)  # a handful of documents, one of them most of its source
    again = source_mix.balance(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["copies"]) for r in rows)
    assert key(got) == key(again)
    assert source_mix.balance(docs.limit(0)).count() == 0
    assert source_mix.balance(docs.withColumn("text", F.lit(None).cast("string"))).where("copies > 0").count() == 0


def test_mix_of_the_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix(table.collect(), source_mix.balance(table).collect(), near=0.05)
    mixed = source_mix.repeat_rows(table)
    assert mixed.columns[: len(table.columns)] == table.columns
    copies = source_mix.balance(table).agg(F.sum("copies")).first()[0]
    assert mixed.count() == copies


def test_repeated_rows_get_all_that_the_mix_took(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "GROUP_DOCS", 64)
    rows = [(None, "one two three", "a", i) for i in range(300)] + [(7, "four five", None, i) for i in range(50)] + [(i, "six seven", "b", i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    taken, got = Counter(), Counter()
    for r in source_mix.balance(df).collect():
        taken[r["doc_id"], r["source"]] += r["copies"]
    mixed = source_mix.repeat_rows(df).collect()
    for r in mixed:
        got[r["doc_id"], r["source"]] += 1
    assert got == +taken and taken[None, "a"] % 300
    assert len({(r["doc_id"], r["source"], r["n"], r["mix_copy"]) for r in mixed}) == len(mixed)


def test_mix_of_clashing_columns(spark):
    rows = [(i, "one two three " * (1 + i % 4), "a" if i % 3 else "b", 9, 9, 9, "x", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int, MIX_COPY int, copies int, doc_id_of_mix string, mark string")
    mixed = source_mix.repeat_rows(df)
    assert mixed.columns == ["doc_id", "text", "source", "copies", "doc_id_of_mix", "mark", "mix_copy", "mix_size", "mix_source_size", "mix_target"]
    assert mixed.count() == source_mix.balance(df).agg(F.sum("copies")).first()[0]
    assert {r["mix_size"] for r in mixed.collect()} <= {3, 6, 9, 12}


# --- 9 toxicity --------------------------------------------------------------------------------------------------------------------


def test_toxicity_holds_out_and_scores_everything(spark, docs):
    rng = random.Random(9)
    bad = ["mudface", "grimlout", "slopbrain"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.choice([10, 60, 200])).split()
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels += [(i, int(i % 5 == 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, marked)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = {r["doc_id"] for r in df.where(toxicity.held_out(F.col("doc_id"))).collect()}
    assert got == set(held)
    right = sum((score[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95
    misspelt = spark.createDataFrame([(1, prose(rng, 20) + " mudfface grimlouts"), (2, prose(rng, 22))], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(misspelt, model).collect()}
    assert s[1] > s[2]
    every = toxicity.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r["score"] <= 1 for r in every)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def misspelt(rng, word):
    """word with one letter doubled, dropped, replaced or swapped with the next."""
    i, k = rng.randrange(len(word) - 1), rng.randrange(4)
    return word[:i] + [word[i] * 2, "", rng.choice("abcdefghijklmnopqrstuvwxyz"), word[i + 1] + word[i]][k] + word[i + 1 + (k == 3) :]


def scored_by_hand(model, text):
    """The score of a text, n-gram by n-gram."""
    strongest, words = [], tokens("".join(c.lower() if c.isascii() else c for c in text))
    for w in words:
        marked = b"<" + w + b">"
        total, n = 0.0, 0
        for g in toxicity.GRAMS:
            for i in range(len(marked) - g + 1):
                h = np.uint64(g)
                for c in marked[i : i + g]:
                    h = h * kernel.BASE + np.uint64(c + 1)
                total += float(model.evidence[int(kernel.mix(np.array([h], np.uint64))[0] % np.uint64(toxicity.BUCKETS))])
                n += 1
        strongest.append(total / n + model.bias)
    z = model.weights @ [1.0, max(strongest, default=model.bias), math.log1p(len(words))]
    return 1 / (1 + math.exp(-z))


@pytest.mark.filterwarnings("ignore:overflow")
def test_scores_of_a_fixed_model(spark, docs):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.25, np.array([-1.0, 0.5, -0.1]))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, text in rows:
        if len(text or "") < 4000:
            assert got[i] == pytest.approx(scored_by_hand(model, text or ""), abs=1e-6), i


def test_held_out_recall_and_misspelt_insults():
    """On the 0.1 tables: toxic documents not trained on, and clean ones into which misspelt insults are put."""
    sf = "/root/testdata/sf0.1"
    texts = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    label = {i: y for i, y in zip(*pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()) if y is not None}
    learnt = [i for i in label if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in label if zlib.crc32(str(i).encode()) % 4 == 2]
    model = toxicity.train(pa.array([texts[i] or "" for i in learnt]), np.array([label[i] for i in learnt]))
    found = lambda some: np.concatenate([model.score(*model.strongest(w)) for w in kernel.slices(pa.array(some), lower=True)]) >= 0.3
    toxic, clean = ([texts[i] or "" for i in held if label[i] == y] for y in (1, 0))
    assert found(toxic).mean() >= 0.9 and found(clean).mean() <= 0.06
    uses = [Counter(w for i in learnt if label[i] == y for w in set((texts[i] or "").lower().split())) for y in (1, 0)]
    insults = [w for w, n in uses[0].items() if n >= 20 and uses[1][w] <= 2 and w.isalpha()]
    rng = random.Random(1)
    for n, least in ((1, 0.35), (2, 0.55), (3, 0.7)):
        assert found([" ".join([*t.split(), *(misspelt(rng, rng.choice(insults)) for _ in range(n))]) for t in clean[:300]]).mean() >= least, n


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, ("vile " if i % 2 else "fine ") * 40) for i in range(60)] + [(100, "vile " * 5000), (1, "vile"), (None, "vile")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (None, 1)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts.to_pylist(), toxic.tolist())))
    monkeypatch.setattr(toxicity, "LONGEST", 1000)
    toxicity.fit(df, labels)
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(seen[0][0]) == sorted("vile" if i == 1 else rows[i][1] for i in kept)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2200)
    toxicity.fit(df, labels)
    assert sum(map(len, seen[1][0])) <= 2200 and len(seen[1][0]) >= 8 and set(seen[1][1]) == {0, 1}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, f"word{i % 7} thing other more {'vile' if i % 3 == 0 else 'fine'}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    true = [(i, int(i % 3 == 0)) for i in range(120)]
    false = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in true]
    scores = [[r["score"] for r in toxicity.score(df, toxicity.fit(df, spark.createDataFrame(l, "doc_id long, toxic int"))).orderBy("doc_id").collect()] for l in (true, false)]
    assert scores[0] == scores[1]


def test_without_labels_every_score_is_the_share(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r["score"], 3) for r in toxicity.score(docs, model).collect()} == {0.0}


# --- 10 n-gram join -------------------------------------------------------------------------------------------------------------------


def shingles(text, n):
    w = [bytes(kernel.LOWER[np.frombuffer(x, np.uint8)]) for x in tokens(text)]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    return sorted((i, len(sets[i]), find(i)) for i in sets)


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (3, 80, 100), (1, 50, 100)])
def test_components(spark, docs, n, num, den):
    rng = random.Random(n)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for g in range(6):
        base = prose(rng, rng.choice([4, 12, 30, 80, 300]))
        rows += [(1000 + 50 * g + k, edited(rng, base, rng.randrange(1 + len(base.split()) // 12) if k else 0)) for k in range(12)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = ngram_join.near_duplicates(df, n, (num, den)).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute_components(rows, n, num, den)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_signatures_are_complete():
    """Sets within the similarity share a signature, sizes and edits at random up to the bound."""
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        for _ in range(300):
            n = int(rng.choice([5, 9, 14, 30, 75, 200, 900]))
            x = np.unique(kernel.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
            drop, add = int(rng.integers(0, max(1, n // 3))), int(rng.integers(0, max(1, n // 3)))
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], kernel.mix(rng.integers(0, 2**62, add).astype(np.uint64))]))
            common = len(np.intersect1d(x, y))
            if len(x) and len(y) and den * common >= num * (len(x) + len(y) - common) and common < max(len(x), len(y)):
                assert len(np.intersect1d(ngram_join.signatures(x, num, den), ngram_join.signatures(y, num, den)))


def test_components_of_long_chains_and_random_graphs(spark):
    """The shuffled chain needs hundreds of rounds where labels move one link a round."""
    rng = random.Random(11)
    chain = rng.sample(range(1000), 1000)
    links = list(itertools.pairwise(chain)) + [(2000 - i, 1999 - i) for i in range(300)]
    links += [(3000 + rng.randrange(400), 3000 + rng.randrange(400)) for _ in range(250)] + [(5000, 5000 - i) for i in range(1, 40)]
    parent = {i: i for pair in links for i in pair}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    linked = {i for a, b in links if a != b for i in (a, b)}
    got = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in got) == sorted((i, find(i)) for i in linked)
    assert connected(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_every_link_counts(spark, docs, monkeypatch):
    """Links inside components too, for each document as many as brute force finds; classes cut into several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = prose(rng, 60)
    rows += [(1000 + k, edited(rng, base, k % 4)) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 3) for i, t in rows if i is not None}
    expected = Counter()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            expected.update((a, b))
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(df, 3, (80, 100), count_links=True).collect()}
    assert got == {i: expected[i] for i in sets} | {None: 0}
    components = Counter(c for _, _, c in brute_components(rows, 3, 80, 100))
    assert any(0 < expected[i] < components[c] - 1 for i, _, c in brute_components(rows, 3, 80, 100))


def test_links_by_sql(spark):
    compare(spark, queries.op10_ngram_links, oracles.OP10_LINKS, SF)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(df, 3, (90, 100)).count() == 0


def test_tables_by_sql(spark):
    compare(spark, queries.op4_substring_dedup, oracles.OP4, SF)
    compare(spark, queries.op10_ngram_join, oracles.OP10, SF)


def test_keep_one_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x"), (None, "x"), (3, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in ngram_join.keep_one(df).collect()) == ["1", "3", "None", "None"]


def test_an_id_with_several_texts(spark, monkeypatch):
    """Its texts link each for itself, the id joins what they reach; when one of a group stays, unrelated texts all stay."""
    monkeypatch.setattr(ngram_join, "SIEVE_BITS", 64)
    rng = random.Random(14)
    one, two, lone = prose(rng, 90), prose(rng, 70), prose(rng, 50)
    rows = [(1, one), (1, two), (2, edited(rng, one, 1)), (3, edited(rng, two, 1)), (7, lone), (8, lone.upper()), (8, lone.upper()), (9, "")]
    df = spark.createDataFrame([(i, t, 4, "k", 1, 2, 3) for i, t in rows], "doc_id long, text string, id_ int, key string, word int, bits int, id int")
    got = ngram_join.near_duplicates(df, 3, (80, 100), count_links=True).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 7, 2), (8, 7, 2), (8, 7, 2), (9, 9, 0)]
    kept = ngram_join.keep_one(df, 3)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, one), (1, two), (7, lone), (9, "")])


def test_pairs_of_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTS", 1 << 20)
    monkeypatch.setattr(ngram_join, "DEAL_FROM", 1000)
    table = spark.range(6000).select(F.col("id").alias("at"), (F.col("id") * 2).alias("n"))
    pairs = [(i, 7) for i in range(100, 5000)] + [(9, i) for i in range(1000, 3500)] + [(1, 2)]
    got = ngram_join.paired(spark.createDataFrame(pairs, "a long, b long"), table, ["n"]).collect()
    assert sorted(tuple(r[c] for c in ("a", "b", "n_a", "n_b")) for r in got) == sorted((a, b, 2 * a, 2 * b) for a, b in pairs)


# --- pipeline ----------------------------------------------------------------------------------------------------------------------------


def test_stages(spark):
    """Every stage against a brute-force version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], SF)
        frames.append(spark.createDataFrame(out.collect(), out.schema))
        if name != "source_mix":
            assert frames[-1].columns == docs.columns
    rows = [f.collect() for f in frames]
    assert {r["doc_id"] for r in rows[1]} == {i for i, s in scores.items() if s < 0.3}
    short = [r for r in rows[0] if len(r["text"] or "") < 1500][:40]
    assert all(scores[r["doc_id"]] == pytest.approx(scored_by_hand(model, r["text"] or ""), abs=1e-6) for r in short)
    groups = brute_components([(r["doc_id"], r["text"]) for r in rows[1]], 5, 80, 100)
    assert {r["doc_id"] for r in rows[2]} == {c for _, _, c in groups}
    stripped = {i: (gone, kept) for i, _, gone, kept in brute_dedup([(r["doc_id"], r["text"]) for r in rows[2]], 35)}
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    for r in rows[3]:
        gone, kept = stripped[r["doc_id"]]
        assert r["text"] == (kept if gone else before[r["doc_id"]]) and (not gone or r["n_chars"] == len(kept))
    leaky = {r["doc_id"] for r in decontaminate.find_overlaps(frames[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in rows[3]} - leaky
    clean = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) + " "
    items = [clean(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in clean(r["text"]) for r in rows[4] for item in items if len(item.split()) >= 5)
    got = source_mix.balance(frames[4]).collect()
    check_mix(rows[4], got, near=0.05)
    taken = defaultdict(int)
    for r in rows[5]:
        taken[r["source"]] += len(tokens(r["text"]))
    assert taken == {s: n for s, n in ((s, sum(r["copies"] * r["size"] for r in got if r["source"] == s)) for s in {r["source"] for r in got}) if n}
    copies = Counter(r["doc_id"] for r in rows[5])
    assert copies == {r["doc_id"]: r["copies"] for r in source_mix.balance(frames[4]).collect() if r["copies"]}


def test_stages_on_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, rows that repeat, ids with several texts, clashing columns; an empty table."""
    rng = random.Random(16)
    items, passage = [prose(rng, 20), prose(rng, 40)], prose(rng, 60)
    texts = awkward() + [(100, prose(rng, 30) + " " + items[0]), (101, prose(rng, 30) + " " + passage), (102, passage + " " + prose(rng, 9)), (103, None)]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i, "x", 1, 2.0, "w") for i, t in texts]
    rows += [(None, "text of a row without id", "en", "s1", 5, None, None, None, None, None), rows[0], rows[9], rows[9], (9, prose(rng, 44), "en", "s1", 9, 0, "y", 0, 0.0, "w")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id_ long, key string, mix_size int, spans double, word string"
    df = spark.createDataFrame(rows, kinds)
    spark.createDataFrame(list(enumerate(items)) + [(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        found[name] = out.collect()
        if name != "source_mix":
            assert out.columns == df.columns and out.schema == df.schema
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert len(found["toxicity"]) == len(rows)  # no toxic label: nothing to learn
    groups = {c for _, _, c in brute_components([(n, r[1]) for n, r in enumerate(rows) if r[0] is not None], 5, 80, 100)}
    kept = Counter((r["doc_id"], r["text"]) for r in found["ngram_jaccard_join"])
    # One row of every group, all rows without words or id.
    assert kept.total() == len({g for g in groups if tokens(rows[g][1])}) + sum(1 for r in rows if r[0] is None or not tokens(r[1]))
    gone = {r["doc_id"] for r in found["substring_dedup"] if r["doc_id"] in (101, 102) and passage.split()[30] in (r["text"] or "").split()}
    assert len(found["substring_dedup"]) == len(rows) and not gone
    assert {r[0] for r in rows} - {r["doc_id"] for r in found["benchmark_decontamination"]} == {100}
    assert all(r["mix_copy"] in (1, 2) and tokens(r["text"]) for r in found["source_mix"])
