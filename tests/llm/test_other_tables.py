"""Vectors, conversations and pages against plain Python."""

import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest

from wayfleet.llm import chat, permutation, queries, topk, urlgraph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


# -- vectors ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, query_id long, score double, dim int"


def vectors(spark, made):
    return spark.createDataFrame([(i, v, 0, 5, 0.5, 3) for i, v in made], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(1)
    made = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 9)]) for i in range(1, 150)]
    made += [(200, made[3][1]), (300, made[3][1]), (300, made[3][1]), (301, made[5][1]), (400, [0.0] * 9)]
    return made + [(500, None), (None, made[0][1]), (501, [1.0] * 8 + [None]), (502, [float("nan")] * 9), (503, [float("inf")] * 9), (600, [1.0, 2.0]), (504, [])]


def plain_vectors(made, zero):
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))
    return {i: np.array(v) for i, v in made if i is not None and ok(v)}


def test_top_k_of_odd_vectors(spark):
    held = {i: np.floor(64 * v) for i, v in plain_vectors(odd_vectors(), True).items()}
    want = []
    for q in (i for i in held if i % 20 == 0):
        scores = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:20], 1)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, odd_vectors())).collect())) == sorted(want)
    assert topk.top_k(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("ties", [False, True])
def test_pruned_search_finds_every_best_score(ties):
    rng = np.random.default_rng(2)
    rows = rng.integers(-2, 3, (3000, 24)).astype(float) if ties else np.floor(64 * rng.normal(0, 1, (3000, 24)) * rng.random((3000, 1)))
    asked = rows[:40]
    same = np.arange(40)[:, None] == np.arange(3000)[None]
    got, exact = topk.search(asked, rows, same, 20), np.where(same, -np.inf, asked @ rows.T)
    for g, e in zip(got, exact):
        least = np.sort(e)[-20]
        assert (g[e >= least] == e[e >= least]).all() and (g[e < least] < least).all()
    if not ties:
        assert (got == -np.inf).mean() > 0.2


def test_segment_bound_holds_at_every_resolution():
    rng = np.random.default_rng(3)
    a, b = rng.normal(1, 2, (50, 23)), rng.normal(0, 1, (60, 23))
    exact = topk.squared_distances(a, b)
    bounds = [topk.squared_distances(topk.segment_statistics(a, s), topk.segment_statistics(b, s)) for s in (1, 2, 8, 23, 64)]
    assert all((x <= exact + 1e-9).all() for x in bounds) and np.allclose(bounds[-1], exact)


def test_permutation_index_reaches_the_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet") if os.path.isdir("/root/testdata/sf0.1") else spark.read.parquet(f"{SF}/embeddings.parquet")
    held = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    ids, x = np.array(sorted(held)), np.stack([held[i] for i in sorted(held)])
    hits = total = 0
    got = permutation.nearest(table).toPandas()
    for q, found in got.groupby("query_id"):
        apart = np.sqrt(((x - held[q]) ** 2).sum(1))
        apart[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, apart))[:10]])
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11)) and np.allclose(found["score"], apart[np.searchsorted(ids, found["vec_id"])], atol=1e-12)
        hits, total = hits + len(want & set(found["vec_id"])), total + 10
    assert set(got["query_id"]) == {i for i in held if i % 100 == 0} and hits / total >= 0.9


def test_recall_where_one_vector_holds_a_third_of_the_rows(spark):
    path = next((p for p in ("/root/testdata/sf0.1", SF) if os.path.isdir(p)))
    made = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    first = max(i for i, _ in made) + 1
    made += [(first + n, made[7][1]) for n in range(len(made) // 2)]
    ids, x = np.array([i for i, _ in made]), np.array([v for _, v in made])
    copied = (x == x[7]).all(1)
    hits = total = 0
    got = permutation.nearest(vectors(spark, made), every=20).toPandas()
    for q, found in got.groupby("query_id"):
        at = int(np.flatnonzero(ids == q)[0])
        apart = np.sqrt(((x - x[at]) ** 2).sum(1))
        apart[at] = np.inf
        want = ids[np.lexsort((ids, apart))[:10]].tolist()
        found = found.sort_values("rank")["vec_id"].tolist()
        assert len(found) == 10 and (not copied[at] or found == want)
        if not copied[at]:
            hits, total = hits + len(set(want) & set(found)), total + 10
    print("recall outside the copies", hits / total)
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9


def test_nearest_of_odd_vectors(spark):
    held = plain_vectors(odd_vectors(), False)
    want = {}
    for q in (i for i in held if i % 100 == 0):
        want[q] = [i for _, i in sorted((float(np.sqrt(((held[q] - v) ** 2).sum())), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:10]]
    got = {}
    for r in sorted(permutation.nearest(vectors(spark, odd_vectors())).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: v for q, v in want.items() if v} and 400 not in got
    assert permutation.nearest(vectors(spark, [])).count() == 0


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(4)
    orders = np.array([rng.permutation(30)[:8] for _ in range(200)])
    place = np.full((200, 30), 8)
    np.put_along_axis(place, orders, np.arange(8)[None].repeat(200, 0), 1)
    files = permutation.InvertedFiles(orders, 30)
    for q in range(5):
        assert (files.footrule(orders[q]) == np.abs(place - place[q]).sum(1)).all()


# -- conversations --------------------------------------------------------------------------------------------

SAID = ["</s>", "[INST] x [/INST]", r"<\/s>", r"[\\INST]", "[", "<", "plain", "", None, "[[INST]</s></s>", "[ROLE]a[/ROLE]", "x\n</s", "/s>", r"[\/SYS]", "$1 \\ \\\\"]
ROLES = ["user", "assistant", "system", "tool", "", None, "[/ROLE]", "a</s>b", "[INST]", "us\ner"]


def conversations(spark):
    rng = random.Random(1)
    made = [(c, t, rng.choice(ROLES), rng.choice(SAID) if rng.random() < 0.7 else " ".join(str(rng.choice(SAID)) for _ in range(3)))
            for c in range(60) for t in range(rng.randint(1, 6))]
    made += [(100, 0, "user", "same"), (100, 0, "user", "same"), (100, None, "assistant", "first"), (None, 0, "assistant", "x" * 100_000)]
    return spark.createDataFrame([(*m, "x", 1) for m in made], "conv_id long, turn long, role string, text string, formatted string, source int"), made


def test_chat_round_trip(spark):
    df, made = conversations(spark)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    groups = {}
    for c, t, role, text in made:
        groups.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    example = chat.format_conversations(chat.with_example(df.limit(0))).collect()
    assert example[0]["formatted"] == r"[INST]<\/s>[\INST] ok [\/INST]</s>[/INST]<\/s>[\INST] ok [\/INST]</s>"
    assert chat.digest(df.limit(0)).count() == 0


def test_chat_sql_agrees_on_odd_turns(spark):
    df, made = conversations(spark)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [m for m in made if m[0] is not None and m[1] is not None])
    want = db.execute(chat.ORACLE).fetchall()
    got = chat.digest(chat.with_example(df.filter("conv_id IS NOT NULL AND turn IS NOT NULL"))).collect()
    assert sorted(map(tuple, got)) == sorted(want)


# -- pages -------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, trust double"


def pages(spark, made):
    return spark.createDataFrame([(n, u, h, "x", 1.0) for n, (u, h) in enumerate(made)], PAGES)


def rule(host, path):
    best = (None, None)
    for verdict, name, start in sorted(urlgraph.RULES, key=lambda r: len(r[1] + r[2])):
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            best = (name + start, verdict)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]


def linked():
    link = lambda *hosts: " ".join(f'<a HREF = "//{h}/x">' if n % 2 else f"<a href='https://{h}'>" for n, h in enumerate(hosts))
    return [("http://Good.example.net/en/1", link("a.example.com", "b.example.com", "b.example.com")), ("https://bad.net/x", link("a.example.com")),
            ("http://c.example.com/en/", link("BAD.net", "bad.net", "d.example.com")), ("http://d.example.com", link("c.example.com", "d.example.com")),
            ("http://a.example.com/de/1", None), ("http://a.example.com/en", "<a href='/local'>"), ("http://b.example.com?x#y", ""), ("http://xnet/a", ""), ("http://wide.example.com/", "<a href          =\n\t            'http://b.net/'>"),
            ("http://net", ""), ("http://net/", ""), ("http://org/fr/a?b", ""), ("http://org/fr", ""), ("no scheme", link("bad.net")), (None, link("a.example.com")),
            ("://x.net/a", ""), ("http://x.net#/", ""), ("a://b://c.net/x", ""), ("http://e.example.com/é", ""), ("http://e.example.com/é", "")]


def test_pages_equal_a_plain_walk(spark):
    made = linked()
    parts = [split(u) for u, _ in made]
    ruled = [rule(*p) for p in parts]
    edges = {}
    for (host, _), (_, html) in zip(parts, made):
        for dst in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)""", html or ""):
            if host and dst.lower() != host:
                edges[host, dst.lower()] = edges.get((host, dst.lower()), 0) + 1
    hosts = {h for h, _ in parts if h} | {d for _, d in edges}
    share = lambda h, v: np.mean([r[1] == v for (x, _), r in zip(parts, ruled) if x == h]) if any(x == h for x, _ in parts) else 0.0
    good, bad = ({h: share(h, v) for h in hosts} for v in ("allow", "block"))
    sent = {h: sum(n for (s, _), n in edges.items() if s == h) for h in hosts}
    came = {h: sum(n for (_, d), n in edges.items() if d == h) for h in hosts}
    stay = 1 - urlgraph.DAMPING
    trust, distrust = ({h: s[h] * stay for h in hosts} for s in (good, bad))
    for _ in range(urlgraph.ROUNDS):
        trust, distrust = ({h: stay * good[h] + urlgraph.DAMPING * sum(trust[s] * n / sent[s] for (s, d), n in edges.items() if d == h) for h in hosts},
                           {h: stay * bad[h] + urlgraph.DAMPING * sum(distrust[d] * n / came[d] for (s, d), n in edges.items() if s == h) for h in hosts})
    want = []
    for n, ((host, path), (name, verdict)) in enumerate(zip(parts, ruled)):
        own = "block" if host and distrust[host] >= urlgraph.THRESHOLD and distrust[host] > trust[host] else "allow"
        want.append((n, host, path, name, verdict or own))
    got = sorted(tuple(r)[:5] for r in urlgraph.judge(pages(spark, made)).collect())
    assert got == want
    assert ("block" in {w[4] for w in want if w[1] == "c.example.com"})   # links to a blocked host
    assert urlgraph.judge(pages(spark, [])).count() == 0


def test_scores_solve_the_linear_system(spark):
    """A cycle H, M beside a host S with a fifth of its pages blocked, and a hub nine links before ten blocked hosts."""
    path = [f"p{n}.xx" for n in range(9)]
    links = {"h.xx": ["m.xx", "s.example.com"], "m.xx": ["h.xx"], **{a: [b] for a, b in zip(path, path[1:])}, path[-1]: [f"b{n}.net" for n in range(10)]}
    made = [(f"http://{a}", " ".join(f'<a href="http://{b}/">' for b in to)) for a, to in links.items()]
    made += [(f"http://s.example.com/{'de' if n == 0 else 'en'}/{n}", "") for n in range(5)] + [(f"http://b{n}.net/", "") for n in range(10)]
    hosts = sorted({split(u)[0] for u, _ in made})
    at = {h: n for n, h in enumerate(hosts)}
    link = np.zeros((len(hosts), len(hosts)))
    for a, to in links.items():
        for b in to:
            link[at[a], at[b]] = 1
    bad = np.array([1.0 if h.endswith(".net") else 0.2 if h == "s.example.com" else 0.0 for h in hosts])
    back = link / np.maximum(1, link.sum(0))
    want = np.linalg.solve(np.eye(len(hosts)) - urlgraph.DAMPING * back, (1 - urlgraph.DAMPING) * bad)
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlgraph.host_scores(pages(spark, made)).collect()}
    print("distrust of h, m, p0:", *(got[h][1] for h in ("h.xx", "m.xx", "p0.xx")), "solved:", *(want[at[h]] for h in ("h.xx", "m.xx", "p0.xx")))
    assert set(got) == set(hosts) and all(abs(got[h][1] - want[at[h]]) < 1e-5 and got[h][0] == 0 for h in hosts)
    verdicts = {r["host"]: r["verdict"] for r in urlgraph.judge(pages(spark, made)).collect()}
    assert verdicts["h.xx"] == verdicts["p0.xx"] == "block"


def test_registered_queries_agree_with_their_sql(spark):
    db = duckdb.connect()
    for name in ("embeddings", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == sorted(db.execute(sql).fetchall()), name
