"""Embeddings, tool calls, URLs and the pipeline against plain versions and odd tables."""

import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from findloom.llm import chat, embeddings, oracle, quality, skew, urls
from findloom.llm import queries as queries

FOLDER = "/root/testdata/sf0.001"


def test_embedding_links_equal_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = table.collect()
    got = {r["vec_id"]: r for r in embeddings.embedding_groups(table).collect()}
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    n = near.sum(axis=1) - 1
    links = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (links <= n).all() and links.sum() >= 0.9 * n.sum()


def test_the_forest_finds_links_in_the_largest_table(spark, monkeypatch):
    """Several trees of several levels, on the table as it is and near copies of half of it: it has no links of its own."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    rng = np.random.default_rng(11)
    x = np.array([r[1] for r in rows], dtype=float)
    noise = rng.standard_normal(x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / 8 * rng.uniform(0.05, 0.2, (len(x), 1))
    x = np.concatenate([x, (x + noise)[::2]])
    rows += [(100_000 + i, x[len(rows) + k].tolist(), rows[i][2]) for k, i in enumerate(range(0, len(rows), 2))]
    made = []
    plain = embeddings.Forest.__init__

    def noted(self, sample, trees, depth, *rest):
        made.append((trees, depth))
        plain(self, sample, trees, depth, *rest)

    monkeypatch.setattr(embeddings.Forest, "__init__", noted)
    planted = spark.createDataFrame([(i, list(map(float, v)), c) for i, v, c in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(planted).collect()}
    assert made[0][0] == embeddings.TREES and made[0][1] >= 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    n = ((x @ x.T >= 0.98) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    links = np.array([got[r[0]] for r in rows])
    print("recall", links.sum() / n.sum(), n.sum())
    assert (links <= n).all() and links.sum() >= 0.9 * n.sum() and n.sum() > 1000


@pytest.mark.parametrize("large", [embeddings.LARGE, 50])
def test_forest_recall_blocks_and_copies(spark, monkeypatch, large):
    monkeypatch.setattr(embeddings, "LARGE", large)
    monkeypatch.setattr(embeddings, "LEAF", 40 if large > 50 else 400)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:150] + 0.02 * rng.standard_normal((150, 16)), np.repeat(base[:1], 200, axis=0)])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.embedding_groups(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.98).sum(axis=1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= n).all() and links.sum() >= 0.9 * n.sum()
    assert got[449]["component_id"] == 149 and not got[460]["kept"] and got[460]["component_id"] == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, "x"), (2, [2.0, 0.0], 0, "x"), (3, [0.0, 0.0], 0, "x"), (4, None, 0, "x"), (5, [nan, 1.0], 0, "x"),
        (6, [inf, 1.0], 0, "x"), (7, [1.0, 0.0], None, "x"), (8, [1.0, 0.0], 1, "x"), (9, [1.0, 0.0, 0.0], 0, "x"),
        (10, [], 0, "x"), (2, [2.0, 0.0], 0, "x"), (11, [None, 1.0], 0, "x"), (None, [1.0, 0.0], 0, "x"),
        (20, [1e200, 0.0], 3, "x"), (21, [2e200, 0.0], 3, "x"), (22, [1e-200, 0.0], 3, "x"), (23, [3e-310, 0.0], 3, "x"),
        (None, [1.0, 2.0], 4, "x"), (None, [2.0, 4.0], 4, "x"), (0, [0.5] * 9 + [1e9], 0, "long" * 50_000),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = sorted(map(tuple, embeddings.embedding_groups(table).collect()), key=repr)
    by_id = {r[0]: r for r in got}
    assert len(got) == len(rows) and by_id[1] == (1, 3, 1, True) and by_id[2] == (2, 3, 1, False)
    assert sorted((r[1:] for r in got if r[0] is None), key=repr) == [(1, None, True), (1, None, True), (3, 1, False)]
    assert all(by_id[i] == (i, 3, 20, i == 20) for i in (20, 21, 22, 23))
    assert all(by_id[i] == (i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert embeddings.embedding_groups(table.where("false")).count() == 0


TOOLS = {"t": [chat.Parameter("x", "integer"), chat.Parameter("y", "string", False)]}
CALLS = "conv_id long, position long, call_id string, tool string, arguments string, after string, depth string"
RESULTS = "conv_id long, position long, call_id string, content string, first string"


def test_tool_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "t", '{"y":"s", "x":1}', None, "-"), (1, 1, "b", "t", '{"y":2}', "a", "-"),
            (1, 2, "c", "t", "[1]", "b", "-"), (1, 3, "c", "u", "{}", "b", "-"), (2, 0, "p", "t", '{"x":1.5,"z":[1]}', "q", "-"),
            (2, 1, "q", "t", None, "p", "-"), (2, 2, None, "t", '{"x":null}', "zz", "-"), (1, 0, "a", "t", '{"y":"s", "x":1}', None, "-"),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 5, "a", "r1", "-"), (1, 4, "a", "r0", "-"), (3, 1, "zzz", "lost", "-"), (3, 1, None, "n", "-")], RESULTS)
    rows = chat.link_tool_calls(calls, results, TOOLS).collect()
    got = sorted((r["call_id"] or "", r["depth"], r["n_results"], r["errors"]) for r in rows)
    assert got == sorted([
        ("a", 0, 2, ""), ("a", 0, 0, "repeated id"), ("a", 0, 1, "repeated result"), ("b", 1, 0, "missing x; type of y"), ("c", 2, 0, "bad arguments"),
        ("c", 0, 0, "repeated id; unknown tool"), ("p", -1, 0, "cycle; type of x; unknown z"), ("q", -1, 0, "cycle; bad arguments"),
        ("", 0, 0, "no id; unknown dependency; missing x"), ("zzz", 0, 1, "no call"), ("", 0, 1, "no id; no call"),
    ])
    assert '{"arguments":{"x":1,"y":"s"},"id":"a","result":"r0","tool":"t"}' in {r["line"] for r in rows}
    for conv in {r["conv_id"] for r in rows}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["order"])
        assert [r["order"] for r in own] == list(range(len(own)))
        assert [(r["depth"], r["position"]) for r in own] == sorted((r["depth"], r["position"]) for r in own)
    assert chat.link_tool_calls(calls.where("false"), results.where("false"), TOOLS).count() == 0


def test_hot_identifiers_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    tools = {"t": [chat.Parameter("x", "integer", least=0, most=9), chat.Parameter("s", "string", False, most=2)]}
    calls = [(1, i, f"c{i}", "t", f'{{"x":{i}}}', "c0" if i else None, "-") for i in range(12)]
    calls += [(1, 20, "c5", "t", '{"x":1,"s":"abc"}', None, "-")] * 1500 + [(None, None, "n", None, '{"x":1}', None, "-")]
    results = [(1, 50 + i % 2, "c0", f"r{i % 3}", "-") for i in range(9)]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools).collect()
    assert len(rows) == len(calls) + len(results) - 1
    by_id = {r["call_id"]: r for r in rows if r["errors"] in ("", "range of x")}
    assert [by_id[f"c{i}"]["depth"] for i in range(12)] == [0] + [1] * 11 and by_id["c0"]["n_results"] == 9
    assert by_id["c9"]["valid"] and not by_id["c10"]["valid"] and '"result":"r0"' in by_id["c0"]["line"]
    assert sum(r["errors"] == "repeated id; range of s" for r in rows) == 1500 and sum(r["errors"] == "repeated result" for r in rows) == 8
    assert sorted(r["order"] for r in rows if r["conv_id"] == 1) == list(range(len(rows) - 1))


def test_a_long_chain_of_calls(spark):
    rows = [(1, i, f"c{i}", "t", '{"x":1}', f"c{i - 1}" if i else None, "-") for i in range(100)]
    calls = spark.createDataFrame(rows, CALLS)
    found = chat.link_tool_calls(calls, spark.createDataFrame([], RESULTS), TOOLS)
    assert {r["call_id"]: r["depth"] for r in found.collect()} == {f"c{i}": i for i in range(100)}


def test_conversations_become_calls(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    odd = spark.createDataFrame([(None, 1, "user", "x"), (1, None, "assistant", "y"), (10**6, 0, "tool", "z"), (10**6, 1, None, None)], turns.select("conv_id", "turn", "role", "text").schema)
    rows = turns.select("conv_id", "turn", "role", "text").union(odd)
    table = rows.collect()
    out = chat.link_tool_calls(*chat.turns_as_calls(rows), chat.TURN_TOOLS).collect()
    first, answers = {}, {}
    for r in sorted((r for r in table if r["conv_id"] is not None and r["turn"] is not None), key=lambda r: str(r["text"])):
        key = r["conv_id"], r["turn"]
        if r["role"] == "assistant":
            answers[key[0], key[1] - 1] = answers.get((key[0], key[1] - 1), 0) + 1
        else:
            first.setdefault(key, r)
    taken = sum(1 for k in first if answers.get(k))
    assert len(out) == len(table) - taken  # every turn is a row, but for results that a call has taken
    got = {r["call_id"]: r for r in out if "repeated" not in r["errors"] and "no call" not in r["errors"]}
    for (conv, turn), r in first.items():
        row = got[f"{conv}:{turn}"]
        assert row["n_results"] == answers.get((conv, turn), 0)
        long, known = len(r["text"] or "") > 2000, r["role"] in ("user", "system")
        assert row["valid"] == (known and bool(r["text"]) and not long and (r["role"] == "user" or turn == 0) and "dependency" not in row["errors"])
    assert sum("unknown tool" in r["errors"] for r in out) == 2 and sum(r["call_id"] is None for r in out) == 2


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.target), default=None)


def test_rules_and_parts_of_urls(spark):
    odd = ["HTTP://A.Com/En/x?y", None, "nope", "a://", "x://h?q/p", "x://b.com/en/", "x://example.com/en/7#z", "x://a://b/c", "x://h\n/p"]
    pages = [r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()] + odd + ["x://deep.org/" + "a/" * 50]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)], "page_id long, url string, template string")
    rows = {r["page_id"]: r for r in urls.judge_urls(table).collect()}
    assert len(rows) == len(pages)
    for i, url in enumerate(pages):
        host, path, rule = plain_url(url)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule and rule.target)
        assert rule is None or rows[i]["verdict"] == rule.verdict
    assert urls.judge_urls(table.where("false")).count() == 0


def plain_kind(segment):
    if segment is None:
        return "end"
    if re.fullmatch("[0-9]+", segment):
        return "number"
    if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", segment):
        return "number.ext"
    if re.fullmatch("[0-9a-f-]{8,}", segment) and re.search("[0-9]", segment):
        return "hex"
    return "mixed" if re.search("[0-9]", segment) else "word"


def plain_templates(rows):
    """``{(host, path): template}`` of ``(host, path, label)`` rows, node by node."""
    out = {}

    def grow(node, level, template):
        """``node``: {path: [segments, n, labelled, blocked]} under one node."""
        live = {}
        for path, r in node.items():
            if len(r[0]) == level:
                out[path] = template
            else:
                live.setdefault(r[0][level], {})[path] = r
        size = lambda branch, i: sum(r[i] for r in branch.values())
        by_kind = {}
        for segment in live:
            by_kind.setdefault(plain_kind(segment), []).append(segment)
        name = {}
        for kind, found in by_kind.items():
            n = sum(size(live[x], 1) for x in found)
            if len(found) >= (urls.MANY_WORDS if kind == "word" else urls.MANY_OTHERS) and len(found) >= urls.SHARE * n:
                name |= {x: "{" + kind + "}" for x in found}
        rest = {x: live[x] for x in live if x not in name}
        kinds = {
            x: [sum(r[1] for r in b.values() if plain_kind(r[0][level + 1] if len(r[0]) > level + 1 else None) == k) for k in urls._KINDS]
            for x, b in rest.items()
        }
        total = [sum(c) for c in zip(*kinds.values(), strict=True)]
        n, labelled, blocked = (sum(size(b, i) for b in rest.values()) for i in (1, 2, 3))
        for x, b in rest.items():
            want = [t * size(b, 1) / n for t in total]
            chi2 = sum((k - e) ** 2 / e for k, e in zip(kinds[x], want, strict=True) if e)
            rate = blocked / labelled if labelled else 0
            agree = not size(b, 2) or abs(size(b, 3) / size(b, 2) - rate) <= 1.96 * (rate * (1 - rate) / size(b, 2)) ** 0.5 + 1e-9
            name[x] = "{like}" if len(rest) > 1 and chi2 <= urls.CHI2 and agree else x
        merged = {}
        for x, b in live.items():
            merged.setdefault(name[x], {}).update(b)
        for x, b in merged.items():
            grow(b, level + 1, f"{template}/{x}")

    hosts = {}
    for host, path, label in rows:
        r = hosts.setdefault(host, {}).setdefault((host, path), [[x for x in path.split("/") if x], 0, 0, 0])
        r[1:] = r[1] + 1, r[2] + (label is not None), r[3] + (label or 0)
    for node in hosts.values():
        grow(node, 0, "")
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_templates_and_verdicts_equal_a_plain_tree(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(skew, "HOT_ROWS", 5)
    rng = np.random.default_rng(4)
    made = [f"http://h{rng.integers(3)}.org/{'/'.join(rng.choice(['a', 'b', 'c', '7', '12', 'x9', '3.html'], rng.integers(0, 6)))}" for _ in range(400)]
    made += [f"http://h.org/{a}/{i}/x" for a in ("en", "fr") for i in range(60)] + ["http://h.org/" + "deep/" * 10 + x for x in ("a", "b", "b")]
    rules = [urls.Rule("block", "h.org/en/"), urls.Rule("block", "h0.org/a/"), urls.Rule("allow", "h0.org/b/"), urls.Rule("block", "h1.org/7")]
    given = [r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    for urls_of, known in ((made, rules), (given, urls.RULES))[: 1 if hot else 2]:
        table = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
        rows = urls.judge_urls(table, known).collect()
        assert sorted(r["page_id"] for r in rows) == list(range(len(urls_of)))
        label = {r.target: int(r.verdict == "block") for r in known}
        want = plain_templates([(r["host"], r["path"], label.get(r["rule"])) for r in rows])
        purity = {}
        for r in rows:
            seen = purity.setdefault((r["host"], want[r["host"], r["path"]]), [2.0, 4.0])
            seen[:] = seen[0] + (label.get(r["rule"]) or 0), seen[1] + (r["rule"] is not None)
        for r in rows:
            template = want[r["host"], r["path"]]
            blocked, labelled = purity[r["host"], template]
            assert r["template"] == template and r["purity"] == pytest.approx(blocked / labelled)
            told = label[r["rule"]] if r["rule"] else blocked / labelled >= urls.PURITY
            assert r["verdict"] == ("block" if told else "allow")
        if urls_of is made:  # what is unlabelled goes with the labelled branch that looks like it
            assert {r["verdict"] for r in rows if r["path"].startswith("/fr/")} == {"block"}


def test_pure_templates_are_blocked_and_mixed_ones_kept(spark):
    rules = [urls.Rule("block", "h.org/spam/1"), urls.Rule("allow", "h.org/mix/1"), urls.Rule("block", "h.org/mix/2")]
    paths = [f"spam/{i}" for i in range(100, 200)] + ["spam/999"] + [f"mix/{i}" for i in range(100, 300)] + ["mix/999"]
    table = spark.createDataFrame([(i, f"http://h.org/{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {paths[r["page_id"]]: r["verdict"] for r in urls.judge_urls(table, rules).collect()}
    assert got["spam/999"] == "block" and got["mix/999"] == "allow"


def test_pipeline_runs_and_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    out = corpus_pipeline.run(spark, FOLDER)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in good.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len({texts[i] for i in ids}) == len(ids)


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_no_two_rows_numbers_in_a_group(spark):
    from findloom.llm.numbering import number_within

    table = spark.createDataFrame([(i % 3, i // 4) for i in range(100)], "g int, k int")
    rows = number_within(table, ["g"], ["k"], "n", 7).collect()
    for g in range(3):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))


@pytest.mark.parametrize("name", ["op1_weighted_tree_sharding", "op7_skip_chain_pii"])
def test_contract_columns(spark, name):
    want = {
        "op1_weighted_tree_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op7_skip_chain_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    }
    assert want[name] <= set(queries.queries()[name](spark, FOLDER).columns)


def _sql_rows(rows, names, sql, table):
    con = duckdb.connect()
    con.execute(f"create table {table} ({names})")
    con.executemany(f"insert into {table} values ({', '.join('?' * len(names.split(',')))})", rows)
    con.execute(sql)
    found = [c[0] for c in con.description]
    return sorted((tuple(dict(zip(found, r, strict=True)).items()) for r in con.fetchall()), key=repr)


def test_odd_turns_give_the_rows_of_the_sql(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "hi \"there\"\n\t\\ é/"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "no"),
        (1, 2, "assistant", None), (1, 3, "user", ""), (1, 3, "user", "x" * 2001), (1, 5, "user", "more"), (1, 5, "system", "late"),
        (2, 0, "user", None), (2, 4, "user", "gap"), (2, 1, "assistant", "ok"), (2, 9, "assistant", "nothing asked"),
        (2, None, "assistant", "when?"), (None, 1, "assistant", "who?"), (None, 1, "user", "q"), (2, None, "user", "q"),
        (3, 0, "tool", "t"), (3, 1, None, "t"), (3, 1, "assistant", "after a tool"), (3, 1, "assistant", "after a tool"),
        (3, -1, "user", "early"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "configure", "same"), (None, None, None, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_tool_calls(*chat.turns_as_calls(turns), chat.TURN_TOOLS)
    theirs = _sql_rows(rows, "conv_id bigint, turn bigint, role varchar, text varchar", oracle.TOOL_CALLS, "conversations")
    mine = sorted((tuple(r.asDict().items()) for r in got.collect()), key=repr)
    assert mine == theirs
    answered = [r for r in map(dict, theirs) if r["tool"] is not None and r["n_results"]]
    assert len(mine) == len(rows) - len(answered)  # only a first result shares its call's row


def test_odd_texts_give_the_rows_of_the_sql(spark):
    phrase = "one two three four five six seven"
    rows = [
        (1, None), (2, ""), (None, " \t\n\x0b "), (3, "a b c d e f g h i j"), (3, f"{phrase} {phrase} and so on"), (4, "x " * 40),
        (5, f"{phrase}\n{phrase}\n\n\n {phrase}\nß é 漢字 #*$%&|<>"), (6, " ".join(f"w{i % 61}" for i in range(30_000))),
        (7, " ".join(f"w{i}" for i in range(200)) + f" {phrase} x {phrase}"), (8, "nine words are one too few for the rule"),
        (9, "ten\u00a0words with\u2003other\x85blanks " * 2), (10, "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z " + phrase),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    theirs = _sql_rows(rows, "doc_id bigint, text varchar", oracle.QUALITY, "documents")
    assert sorted((tuple(r.asDict().items()) for r in quality.quality_rules(docs).collect()), key=repr) == theirs
    assert {r[-1][1] for r in theirs} == {True, False}
