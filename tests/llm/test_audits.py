"""Conversation repair, source divergence and URL filters on awkward tables, against brute force and against their SQL."""

import hashlib
import heapq
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from oracle import compare, connect

from pointloom.llm import conversations, divergence, queries, url_filters

# ---- conversations ------------------------------------------------------------------------------

ROWS = "conv_id long, turn long, role string, text string, chunk string, present2 boolean, code string"


def talks(seed: int, n: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "More text.", "and so on", "é."]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Assistant"])
            for _ in range(rng.choice([1, 1, 1, 2])):
                out.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts), "x", None, "y"))
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str, str]:
    """Least (cost, audit) and its lines, by search over whole label strings; each path is kept, none by state."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, lines = heapq.heappop(heap)
        roles = "".join(x[:1] or "-" for x, _ in lines)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{x}" for r, x in lines)
        if not re.fullmatch("s?(ua)*u?", roles) or (audit, at, roles) in done:
            continue
        done.add((audit, at, roles))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, lines))
            if faults[at] not in ("b", "d"):
                late = int(faults[at] == "t")
                heapq.heappush(heap, (cost + late, audit + "K", at + 1, (*lines, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + late, audit + "R", at + 1, (*lines, (other, text))))
        if audit[-2:] != "II":
            for other in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*lines, (other, ""))))
    raise AssertionError("no end")


@pytest.mark.parametrize("seed", range(40))
def test_path_is_the_cheapest_and_least(seed):
    rows = [(None, r, x) for _, _, r, x, *_ in talks(seed, 1, 5)][:6]
    values, lines = conversations.solved(rows)
    cost, audit, text = cheapest([(r, x) for _, r, x in rows])
    assert (values["cost"], values["audit"]) == (cost, audit)
    assert values["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert "\n".join(f"{r}:{x}" for _, r, x in lines) == text


def by_hand(rows: list[tuple]) -> dict:
    of: dict = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        of.setdefault(conv, []).append((turn, role or "", text or ""))
    return {conv: (conversations.solved(x)) for conv, x in of.items()}


@pytest.mark.parametrize("chunk_rows", [3, 7, 50_000])
def test_chunks_give_what_whole_conversations_give(spark, chunk_rows):
    rows = talks(5, 30, 9) + [(77, k, r, f"{x} {k % 50}", "", None, "") for k, (_, _, r, x, *_) in enumerate(talks(6, 1, 400))] + [(None, None, None, None, "", None, ""), (None, 3, "user", "Hm.", "", None, "")]
    rows += [(78, 1, "user", "Same.", "", None, "")] * 60
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    want = by_hand(rows)
    got = {r["conv_id"]: r for r in conversations.repair(frame, chunk_rows=chunk_rows).collect()}
    assert {k: {c: r[c] for c in conversations.NAMES} for k, r in got.items()} == {k: v for k, (v, _) in want.items()}
    lines = Counter()
    for r in conversations.repaired(frame, chunk_rows=chunk_rows).collect():
        lines[r["conv_id"], r["place"], r["edit"], r["role"], r["text"]] += 1
    assert lines == Counter((conv, k, *x) for conv, (_, xs) in want.items() for k, x in enumerate(xs))


def test_conversations_equal_their_sql_on_awkward_rows(spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3]) for r in talks(9, 120, 12)] + [(None, None, None, None), (None, 1, None, "x."), (900, None, "user", None), (901, 5, "user", "One."), (901, 5, "user", "One."), (902, -7, "system", "y" * 200_000), (903, 2, "a", ""), (904, 9, "", "z.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(str(tmp_path / "conversations.parquet"))
    name = "op11_conversation_repair"
    assert compare(spark, connect(tmp_path), name, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path)) is None


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert conversations.repair(none).collect() == [] and conversations.repaired(none).collect() == []
    gone = spark.createDataFrame([(1, 1, "user", "x", False), (2, 1, "user", "Hm.", True)], "conv_id long, turn long, role string, text string, present boolean")
    got = {r["conv_id"]: r for r in conversations.repair(gone, "present").collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got[2]["cost"], got[2]["audit"]) == (2, "KI")


# ---- divergence ---------------------------------------------------------------------------------


def test_divergence_equals_its_sql_on_awkward_rows(spark, tmp_path, rows):
    rng = random.Random(3)
    words = ["the", "The", "über", "Ñu", "a1b", "x_y", "日本", "ß"] + [f"w{'abcdefghij'[k]}" for k in range(10)]
    more = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "c", "é"])) for k in range(150)]
    more += [(1, "only few", "xx", "s1"), (2, None, "xx", "s2"), (3, "", "yy", "alone")] + [(4, "the same the same", "en", "a")] * 12
    given = [(i, t, lang, source) for i, t, lang, source, *_ in rows] + more
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    name = "op12_source_divergence"
    assert compare(spark, connect(tmp_path), name, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path)) is None


def test_divergence_of_nothing_and_of_clashing_names(spark, none, docs):
    assert divergence.divergence(none).collect() == []
    wide = divergence.divergence(docs.selectExpr("*", "1 as n", "2 as docs", "3 as term", "4 as value"), min_docs=2)
    assert sorted(wide.collect()) == sorted(divergence.divergence(docs.select("text", "lang", "source"), min_docs=2).collect())


def test_terms_of_pieces_are_those_of_the_whole():
    text = "Ünder_score a1b " * 50 + "x" * 300 + " ende Ω"
    whole = [w for part in divergence.terms(text) for w in part]
    for piece in (1, 7, 64, 500):
        assert [w for part in divergence.terms(text, piece) for w in part] == whole
    assert [w.decode() for w in whole[:3]] == ["Ünder", "score", "a"]


def test_shares_of_huge_counts_are_exact(spark):
    n, total, kept = 7_000_000_000_123, 9_999_999_999_999_999, 12_345_678
    got = spark.range(1).select(divergence.share(f"{n}L", f"{total}L", f"{kept}L")).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_postings_are_added_up_alike_however_few_pairs_are_held(monkeypatch):
    rng = random.Random(1)
    postings = [("en" if k % 3 else "de", [{"source": f"s{j}", "p": rng.randint(1, 10**9), "p0": 5 + j} for j in sorted(rng.sample(range(9), rng.randint(1, 9)))]) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in postings]), pa.array([y for _, y in postings])], names=["lang", "posting"])

    def totals() -> Counter:
        out = Counter()
        for b in divergence._shared(iter([batch])):
            for r in b.to_pylist():
                out[r["lang"], r["a"], r["b"]] += r["value"]
        return out

    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for lang, posting in postings:
        for x in posting:
            for y in posting:
                if x["source"] < y["source"]:
                    want[lang, x["source"], y["source"]] += f(x["p"], y["p"]) - f(x["p"], y["p0"]) - f(x["p0"], y["p"]) + f(x["p0"], y["p0"])
    assert totals() == want
    monkeypatch.setattr(divergence, "HELD", 20)
    assert totals() == want


# ---- URL filters --------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/1?q#f", "https://www.example.com/en/", "https://a.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/de/1",
    "http://x.net/fr", "http://x.net/fr/", "http://y.net/de/", "ftp://a://b/c", "http://example.com?/en/", "http://.com/x", "http://com./", "http://ü.net/es/é", "http://h.org/" + "p/" * 50_000, "http://" + "a." * 5_000 + "net/es/", "x\nhttp://n.net/es/\n?", "http://u:p@z.com:80/en/", "http://x.net/de/1",
]


def test_urls_equal_their_sql_on_awkward_rows(spark, tmp_path):
    rows = [(k if k % 5 else None, u, "h", "r", "v") for k, u in enumerate(URLS)]
    spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    name = "op13_url_filter"
    assert compare(spark, connect(tmp_path), name, queries.queries()[name], queries.oracle_sql()[name], str(tmp_path)) is None


def test_no_pages_no_rules_and_lists_of_any_host(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(none).collect() == []
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, rules=[]).collect()} == {1: "allow", 2: "allow", 3: "allow"}
    hosts = spark.createDataFrame([("b.org",), ("",), (None,), ("absent.org",)], "h string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, hosts=hosts).collect()} == {1: (None, "allow"), 2: (None, "block"), 3: (None, "block")}


@pytest.mark.parametrize("part_bytes", [64 << 20, 700])
def test_membership_is_exact_for_every_key(spark, part_bytes):
    """Also where the list is dealt into parts, with keys of every length and lists of several keys, some empty or null."""
    keys = [f"k{k}" + "x" * (k % 40) for k in range(6_000)]
    listed = {k for k in keys if hash_of(k) % 7 == 0}
    rng = random.Random(2)
    lists = [rng.choices(keys, k=rng.randint(0, 5)) for _ in range(3_000)] + [None, []] + [[k] for k in keys]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "found2 long, keys array<string>").repartition(6)
    got = url_filters.members(rows, spark.createDataFrame([(k,) for k in listed], "key string"), part_bytes).collect()
    assert len(got) == len(lists)
    assert all(r["found"] == [k in listed for k in r["keys"] or []] for r in got)


def hash_of(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest(), 16)
