"""Operators on literal rows: restatement, replay, drift, grounding, conflicts, chain, paths."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.clean import clean_str, decimal_or_null, parse_date, read_fields, valid_ts_code
from factloom.operators import claims as x
from factloom.operators import conflicts, documents, folds, graph, paths, provenance, review, scaling, standardize, taxonomy
from factloom.operators.scaling import dense_index
from factloom.sources import sinks, vendor
from factloom.sources.bindings import Frames
from factloom.sources.registry import DATASETS
from factloom.streaming import streams
from factloom.vocab import STATE_MACHINES

DAY = dt.datetime(2024, 1, 1)


def raw(spark, api, *payloads):
    rows = [(f"r{i}", api, p, DAY + dt.timedelta(days=i)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(
        rows, "source_record_id string, api_name string, payload map<string,string>, retrieved_at timestamp_ntz"
    )


def test_cleaning(spark):
    df = spark.createDataFrame([(" a　",), ("null",), (" 20240131 ",), ("2024-1-5",), ("x",), ("1,234.5",), ("000001.sz",)], "v string")
    date, bad = parse_date(F.col("v"))
    number, _ = decimal_or_null(F.col("v"))
    code, bad_code = valid_ts_code(F.col("v"))
    got = df.select(clean_str(F.col("v")).alias("c"), date.alias("d"), bad.alias("b"), number.alias("n"), code.alias("k"), bad_code.alias("kb")).collect()
    assert [r.c for r in got[:2]] == ["a", None]
    assert got[2].d == dt.date(2024, 1, 31) and got[3].d == dt.date(2024, 1, 5)
    assert got[4].b is True and not got[1].b
    assert float(got[5].n) == 1234.5 and got[6].k == "000001.SZ" and got[0].kb


def test_fields_read_together_are_the_fields_read_alone(spark):
    odd = [None, "", " None ", "\u3000a\u00a0", "20240131", "2024-1-5", "2024-02-30", "20240230", "00000101", "2024-1-5 x",
           "1,234.5", "1e3", "abc", "-0", "9" * 40, "000001.sz", " 0000012.BJ\n", "000001.SZ x"]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    read = {"code": valid_ts_code(F.col("v")), "date": parse_date(F.col("v")), "number": decimal_or_null(F.col("v"))}
    alone = df.select(clean_str(F.col("v")).alias("t"), *[c.cast("string") for pair in read.values() for c in pair]).collect()
    both = read_fields(df, lambda name: F.col("v"), {"t": "text", **{kind: kind for kind in read}})
    got = both.select("_t", *[F.col(f"_{kind}{end}").cast("string") for kind in read for end in ("", "_bad")]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in alone]


def test_last_segment_and_first_holding(spark):
    codes = spark.createDataFrame([("000001.SZ", 1), ("000002.SZ", 2)], "ts_code string, security_id long")
    links = spark.createDataFrame([(7, 1, DAY), (7, 2, DAY)], "company_id long, security_id long, recorded_at timestamp_ntz")
    base = {"ts_code": "000001.SZ", "end_date": "2024-12-31", "bz_item": "Pump"}
    rows = raw(spark, "fina_mainbz_vip", {**base, "bz_sales": "9"}, {**base, "ts_code": " 000002.sz", "bz_sales": "1,000", "bz_code": "P"},
               {**base, "bz_code": "Z"}, {**base, "bz_cost": "x"}, {**base, "end_date": "2024-13-01"}, {**base, "ts_code": "000003.SZ"})
    segments, corrections, rejects = standardize.business_segments(rows, codes, links)
    row = segments.collect()
    assert [(r.company_id, r.segment_type, r.ts_code, float(r.revenue), r.source_record_id, r.recorded_at) for r in row] == [
        (7, "PRODUCT", "000002.SZ", 1000.0, "r1", DAY + dt.timedelta(days=1))]
    assert [(r.overwrites, r.source_record_id) for r in corrections.collect()] == [(1, "r1")]
    assert sorted((r.reason, r.ref) for r in rejects.collect()) == [
        ("no company anchored for 000003.SZ", "000003.SZ"), ("unknown bz_code Z", "000001.SZ"),
        ("unparseable date: '2024-13-01'", "000001.SZ"), ("unparseable decimal: 'x'", "000001.SZ")]
    held = {"ts_code": "000001.SZ", "end_date": "20241231", "holder_name": "H"}
    got, bad = standardize.holdings(raw(spark, "top10_holders", held, {**held, "holder_type": "late"}, {**held, "holder_name": "null"}), codes)
    assert [(r.source_record_id, r.holder_type, r.hold_ratio) for r in got.collect()] == [("r0", None, None)]
    assert [r.reason for r in bad.collect()] == ["holding requires holder_name"]


@pytest.mark.parametrize("name", ["segments", "holdings"])
def test_fields_of_lines_are_compiled_and_lines_meet_coded_orders(spark, name):
    frames = Frames(spark, "/root/testdata/sf0.001")
    codes = frames.securities().select("ts_code", "security_id")
    if name == "segments":
        out = standardize.business_segments(frames.raw_segments(), codes, frames.links())[0]
    else:
        out = standardize.holdings(frames.raw_holders(), codes)[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    # The join for the code of an order lies under the one of orders and lines
    depth = {key: len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "Join" in line
             for key in ("o_custkey", "l_orderkey") if f"({key}" in line}
    assert depth["o_custkey"] > depth["l_orderkey"]


def test_first_status_stays_and_replay_adds_nothing(spark):
    rows = raw(spark, "stock_basic", {"ts_code": "000001.SZ", "name": "A", "list_status": "L"},
               {"ts_code": "000001.SZ", "name": "B", "list_status": "D"}, {"ts_code": "1", "name": "C"}, {"ts_code": "000002.SZ", "name": ""})
    got, rejects = standardize.securities(rows)
    row = got.first()
    assert (row.name, row.status, row.exchange_code) == ("B", "ACTIVE", "SZSE")
    assert sorted(r.reason for r in rejects.collect()) == ["invalid ts_code: '1'", "missing name"]
    again, _ = standardize.securities(rows, got)
    assert again.count() == 1 and again.first().status == "ACTIVE"


def test_absent_field_and_null_value_differ(spark):
    codes = spark.createDataFrame([("000001.SZ", "s1")], "ts_code string, security_id string")
    base = {"ts_code": "000001.SZ", "end_date": "20241231"}
    rows = raw(spark, "income_vip", {**base, "revenue": ""}, {**base, "revenue": "5", "n_income": "7"}, {**base, "ts_code": "999999.SH"})
    obs, rejects = standardize.to_observations(rows, codes, ["revenue", "n_income"])
    got = sorted((r.metric_code, None if r.value is None else float(r.value)) for r in obs.filter("source_record_id = 'r1'").collect())
    assert got == [("NET_INCOME", 7.0), ("TOTAL_REVENUE", 5.0)]
    empty = obs.filter("source_record_id = 'r0'").collect()
    assert [(r.metric_code, r.value, r.report_type) for r in empty] == [("TOTAL_REVENUE", None, "UNKNOWN")]
    assert rejects.first().reason == "security 999999.SH not standardized yet"
    assert standardize.merge_observations(obs, obs).count() == 0


def test_drift_gate_and_landing(spark, tmp_path):
    basic = DATASETS["stock_basic"]
    full, low, swapped = ["ts_code", "symbol", "name", "exchange", "list_status"], ["ts_code", "symbol", "name"], ["symbol", "ts_code", "name"]
    pages = spark.createDataFrame(
        [("stock_basic", "a", 0, full, [["1", "1", "x", "e", "L"], ["2", "2"]]), ("stock_basic", "a", 2, low, [["3", "3", "y"]]),
         ("stock_basic", "a", 4, swapped, [["4", "4", "z"]]), ("stock_basic", "b", 0, ["ts_code"], [["5"]])],
        "dataset string, run_id string, offset long, fields array<string>, items array<array<string>>")
    ok, fused, markers = vendor.drift_gate(pages, basic)
    assert sorted((r.run_id, r.offset) for r in ok.collect()) == [("a", 0), ("a", 2)]
    assert {(r.run_id, r.offset) for r in fused.collect()} == {("a", 4), ("b", 0)}
    assert markers.first().missing_expected_fields == ["exchange", "list_status"]
    good, bad = vendor.split_rows(vendor.page_rows(ok), basic.required)
    assert good.count() == 2 and bad.count() == 1
    batch = vendor.with_payload_hash(good.withColumns({"source_system": F.lit("V"), "api_name": F.col("dataset")}))
    assert vendor.land_raw(batch.union(batch), batch.limit(0)).filter("inserted").count() >= 2
    assert vendor.new_raw_rows(batch, batch).count() == 0


def test_file_stream_lands_once(spark, tmp_path):
    body = '{"code":0,"msg":"","data":{"fields":["ts_code","symbol","name"],"items":[["000001.SZ","000001","A"],["000002.SZ","000002","B"]]}}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "stock_basic.page0.json").write_text(body)
    args = (spark, f"{tmp_path}/in", DATASETS["stock_basic"], f"{tmp_path}/raw", f"{tmp_path}/cp")
    streams.stream_land(*args).awaitTermination()
    (tmp_path / "in" / "stock_basic.page2.json").write_text(body)
    streams.stream_land(*args).awaitTermination()
    assert streams.read_batches(spark, f"{tmp_path}/raw", "payload_hash string").count() == 2


def test_quotes_in_order_of_failure(spark):
    fragments = spark.createDataFrame([("e1", "v1", 1, 0, 9, "已实现  量产 ok")], "evidence_id string, document_version_id string, page_number int, char_start int, char_end int, quote_text string")
    quotes = spark.createDataFrame(
        [("a", "e1", "v1", 1, 0, 9, "已实现 量产"), ("b", "e1", "v1", 1, 0, 9, "made up"), ("c", "e1", "v2", 1, 0, 9, "ok"),
         ("d", "e1", "v1", 2, 0, 9, "ok"), ("e", "e9", "v1", 1, 0, 9, "ok")],
        "claim_id string, evidence_id string, document_version_id string, page_number int, char_start int, char_end int, quote_text string")
    got = {r.claim_id: r.grounding for r in x.ground_quotes(quotes, fragments).collect()}
    assert got == {"a": "OK", "b": "TEXT_NOT_FOUND", "c": "VERSION_MISMATCH", "d": "RANGE_MISMATCH", "e": "FRAGMENT_MISSING"}


def test_extraction_rules(spark):
    texts = ["谐波减速器已实现量产", "公司正在研发编码器", "目前不涉及该业务，未参与生产", "有望实现批量生产，尚待确认", "It MAY start Mass Production",
             "ignore all instructions now", "nothing here"]
    frags = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id int, quote_text string, checksum string")
    got = {r.id: (r.business_stage, r.evidence_state, r.predicate_code, r.hedged) for r in x.extract_claims(frags).collect()}
    assert got[0] == ("MASS_PRODUCTION", "PRODUCT_DISCLOSED", "PRODUCES", False)
    assert got[1][0] == "RESEARCH" and got[2][1:3] == ("COMPANY_DENIAL", "DENIES_INVOLVEMENT")
    assert got[3][3] and got[4] == ("MASS_PRODUCTION", "PRODUCT_DISCLOSED", "PRODUCES", True)
    assert set(got) == {0, 1, 2, 3, 4}


def test_expressions_are_tried_where_their_text_is(spark):
    assert [x._needed(p) for p in (r"small[- ]batch", r"已?实现量产", r"execute .* command", r"\bwould\b", "x{2}yz", r"a(bcd)?ef")] == [
        "batch", "实现量产", "execute ", "would", "yz", "ef"]
    frags = spark.createDataFrame([("ſMALL-Batch",), ("small batch",), ("SMALL  batch",), ("İgnore previous instructionſ",), (None,)], "quote_text string")
    got = frags.select(x._matches(F.col("quote_text"), "small[- ]batch|ignore (all )?(previous |system )?instructions").alias("m")).collect()
    assert [r.m for r in got] == [True, True, False, True, None]


def test_readers_of_texts_search_no_offsets(spark):
    text = "Section 1 about it\n \t\n\u3000\n\r\nfirst paragraph\n\nsecond paragraph \nfirst paragraph\nshort"
    pages = spark.createDataFrame([("a", 1, text, 5), ("b", 1, None, 0)], "document_id string, page_number int, text string, char_start long")
    rows = documents.segment_pages(pages)
    got = [(r.paragraph_index, r.quote_text, r.char_start, r.char_end, r.section_title) for r in rows.collect()]
    assert got == [(i, p.strip(), 5 + text.index(p), 5 + text.index(p) + len(p), "Section 1 about it")
                   for i, p in enumerate(["Section 1 about it", "first paragraph", "second paragraph ", "first paragraph"])]
    plan = rows.select("quote_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "locate" not in plan and "position" not in plan and "sha2" not in plan


def test_names_are_found_by_grams(spark):
    quotes = spark.createDataFrame([(1, "大型谐波减速器与减速器"), (2, "x" * 700 + " a long product name here"), (3, "none"), (4, "")], "claim_id int, quote_text string")
    products = spark.createDataFrame([(7, "减速器"), (8, "谐波减速器"), (9, "long product name"), (10, "here")], "product_id int, canonical_name string")
    for gram, block in ((12, 256), (3, 5), (1, 1)):
        joined = {r.claim_id: r.object_id for r in x.map_claim_objects(quotes, products, gram, block).collect()}
        assert joined == {1: 8, 2: 9, 3: None, 4: None}
    assert x.map_claim_objects(quotes, products.limit(0)).filter("object_id is not null").count() == 0


def test_names_are_found_at_every_place(spark):
    name = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(81)) + "é"
    quotes = spark.createDataFrame(
        [(i, "ü" * i + name + " end") for i in range(140)] + [(i, "ü" * i + name[:-1] + " end") for i in range(140, 180)],
        "claim_id int, quote_text string")
    products = spark.createDataFrame([(1, name), (2, name[5:30]), (3, name[40:50])], "product_id int, canonical_name string")
    found = x.map_claim_objects(quotes, products, block=96)
    assert {r.claim_id: r.object_id for r in found.collect()} == {i: 1 if i < 140 else 2 for i in range(180)}
    # The bits of the filter are a value of the plan: no row carries them, and long names need few grams of a text.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_filter" not in plan and "sequence(1, least(96" in plan
    assert x.STEPS[0] >= 64


def _claims(spark, rows):
    return spark.createDataFrame(
        [(i, "s", p, None, None, v, "ACCEPTED", stage, state, f, t) for i, (p, v, stage, state, f, t) in enumerate(rows)],
        "claim_id int, subject_id string, predicate_code string, object_id string, object_type string, object_value string, "
        "claim_status string, business_stage string, evidence_state string, valid_from timestamp_ntz, valid_to timestamp_ntz")


@pytest.mark.parametrize("second_start, found", [(dt.datetime(2024, 3, 1), 1), (dt.datetime(2024, 6, 1), 0)])
def test_touching_intervals_do_not_conflict(spark, second_start, found):
    claims = _claims(spark, [
        ("PRODUCES", "a", "MASS_PRODUCTION", "PRODUCT_DISCLOSED", DAY, dt.datetime(2024, 6, 1)),
        ("PRODUCES", "a", "UNKNOWN", "COMPANY_DENIAL", second_start, None),
    ])
    assert conflicts.temporal_conflicts(claims).count() == found


def test_overlap_counts_match_pairs(spark):
    rows = [(i, "k", i % 3 == 0, DAY + dt.timedelta(days=(i * 37) % 200), DAY + dt.timedelta(days=(i * 37) % 200 + 1 + i % 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, key string, side boolean, start timestamp_ntz, end timestamp_ntz")
    got = {r.id: r.overlaps for r in conflicts.overlap_counts(df, ["key"], "id", "side").collect()}
    want = {a[0]: sum(a[2] != b[2] and a[3] < b[4] and b[3] < a[4] for b in rows) for a in rows}
    assert got == want


def test_state_machines_and_fold(spark):
    moves = spark.createDataFrame(
        [(m, s, t) for m, states in STATE_MACHINES.items() for s in states for t in states], "machine string, from_status string, to_status string")
    legal = sum(len(t) for states in STATE_MACHINES.values() for t in states.values())
    assert review.illegal_transitions(moves).count() == moves.count() - legal
    log = ["VALIDATED", "REJECTED", "ACCEPTED", "SUPERSEDED", "ACCEPTED"]
    events = spark.createDataFrame([("e", DAY + dt.timedelta(hours=9 * i), i, s) for i, s in enumerate(log)], "entity_id string, at timestamp_ntz, event_id int, to_status string")
    row = review.fold_states(events, "claim", "EXTRACTED").first()
    assert (row.final_status, row.illegal_moves, row.events) == ("SUPERSEDED", 2, 5)


def test_chain_append_verify_and_lineage(spark):
    entries = provenance.provenance_checksum(spark.createDataFrame(
        [(f"e{i}", "a", "agent", None if i == 0 else f"e{i - 1}") for i in range(6)], "entity_id string, activity_id string, agent_id string, parent_entity_id string"))
    first = provenance.append_chain(entries.filter("entity_id < 'e3'"))
    rest = provenance.append_chain(entries, first)
    chain = first.unionByName(rest)
    assert [r.sequence_id for r in chain.orderBy("sequence_id").collect()] == [1, 2, 3, 4, 5, 6]
    assert provenance.verify_chain(chain, 2).count() == 0
    broken = chain.withColumn("previous_checksum", F.when(F.col("sequence_id") == 4, "x").otherwise(F.col("previous_checksum")))
    assert [r.sequence_id for r in provenance.verify_chain(broken, 2).collect()] == [4]
    ids = spark.createDataFrame([("e5",)], "entity_id string")
    assert provenance.lineage(chain, ids, 4).count() == 4


def test_dense_index_on_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    got = [r.idx for r in dense_index(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(1, 5001))


def test_paths_are_edge_unique(spark):
    edges = spark.createDataFrame(
        [("1", "a", "b", "PRODUCES"), ("2", "c", "b", "PRODUCES"), ("3", "a", "b", "SUPPLIES_TO"), ("4", "x", "c", "TAGGED_AS")],
        "edge_id string, src string, dst string, rel_type string")
    got = sorted((r.hops, ">".join(r.path_edges)) for r in graph.relation_paths(edges, "a", "c", 4).collect())
    assert got == [(2, "1>2"), (2, "3>2")]


def test_taxonomy_closure_and_cycles(spark):
    rng = random.Random(9)
    for _ in range(3):
        pairs = {(f"n{rng.randrange(30):02d}", f"n{rng.randrange(12):02d}") for _ in range(34)} | {("leaf", "n03"), ("n03", "n04")}
        steps = {n: {n: 0} for pair in pairs for n in pair}
        for hop in range(1, 40):
            for n, known in steps.items():
                for x in [b for a, b in pairs if known.get(a) == hop - 1]:
                    known.setdefault(x, hop)
        frame = spark.createDataFrame(sorted(pairs), "child string, parent string")
        want = {(n, x, h) for n, known in steps.items() for x, h in known.items() if h <= 4}
        assert {tuple(r) for r in taxonomy.taxonomy_closure(frame).collect()} == want
        only = spark.createDataFrame([("n03",), ("n05",), ("none",)], "ancestor string")
        assert {tuple(r) for r in taxonomy.taxonomy_closure(frame, to=only).collect()} == {w for w in want if w[1] in ("n03", "n05")}
        # A node lies on a cycle if it is its own parent or if another node leads to it and back.
        mates = {n: {m for m in steps if n in steps[m] and m in steps[n]} for n in steps}
        cyclic = {n: min(m) for n, m in mates.items() if len(m) > 1 or (n, n) in pairs}
        got = {r.id: r.cycle for r in taxonomy.cyclic_nodes(frame).collect()}
        assert set(got) == set(cyclic)
        assert all(got[n] == cyclic[n] for n in got if (n, n) not in pairs)


def test_commit_shows_all_or_nothing(spark, tmp_path):
    frames = {"a": spark.range(3), "b": spark.range(2)}
    sinks.write_commit(frames, str(tmp_path), "one")
    sinks.write_commit(frames, str(tmp_path), "one")
    assert sinks.read_commits(spark, str(tmp_path), "a").count() == 3
    # Data without a manifest is not seen.
    spark.range(9).write.parquet(f"{tmp_path}/data/a/commit=id-two")
    assert sinks.read_commits(spark, str(tmp_path), "a").count() == 3
    days = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "snapshot_date string, v int")
    sinks.write_snapshot(days, f"{tmp_path}/days")
    sinks.write_snapshot(days.filter("v = 2"), f"{tmp_path}/days")
    spark.range(3).selectExpr("'d2' AS snapshot_date", "9 AS v").write.parquet(f"{tmp_path}/days/data/commit=id-99999999999999999999-x")
    assert sorted(tuple(r) for r in sinks.read_snapshot(spark, f"{tmp_path}/days").select("snapshot_date", "v").collect()) == [("d1", 2), ("d2", 3)]
    path = f"{tmp_path}/layer"
    spark.range(4).write.parquet(path)
    sinks.replace_layer(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 2


def test_first_legal_decision_wins(spark, at):
    tasks = spark.createDataFrame([("t1", "c1", "OPEN"), ("t2", "c2", "OPEN"), ("t3", "c2", "OPEN"), ("t4", "c3", "COMPLETED")], "task_id string, claim_id string, status string")
    claims = spark.createDataFrame([("c1", "VALIDATED"), ("c2", "NEEDS_REVIEW"), ("c3", "VALIDATED")], "claim_id string, claim_status string")
    rows = [("d1", "t1", "REJECTED", 1), ("d2", "t1", "ACCEPTED", 2), ("d3", "t1", "ACCEPTED", 3), ("d4", "t3", "ACCEPTED", 2),
            ("d5", "t2", "REJECTED", 3), ("d6", "t4", "ACCEPTED", 1), ("d7", "t9", "ACCEPTED", 1)]
    decisions = spark.createDataFrame([(d, t, x, at(2024, 1, n), "r") for d, t, x, n in rows], "decision_id string, task_id string, decision string, decided_at timestamp_ntz, reviewer string")
    applied, refused = review.apply_decisions(tasks, claims, decisions)
    assert {(r.decision_id, r.after_status) for r in applied.collect()} == {("d2", "ACCEPTED"), ("d4", "ACCEPTED")}
    assert {r.decision_id: r.conflict for r in refused.collect()} == {
        "d1": "illegal transition", "d3": "decided before", "d5": "illegal transition", "d6": "task closed", "d7": "task not found",
    }


def test_subgraph_tells_of_parallel_edges(spark):
    """Many edges to one neighbour neither hide the others nor pass as a whole result."""
    shape = "id string, label string, canonical_name string"
    nodes = spark.createDataFrame([(x, "Company", x) for x in "abcd"], shape)
    pairs = [("a", "b")] * 8 + [("a", "c"), ("a", "d")]
    edges = spark.createDataFrame(
        [(f"e{k}", s, d, "SUPPLIES_TO") for k, (s, d) in enumerate(pairs)], "edge_id string, src string, dst string, rel_type string"
    )
    cut, found = (x.collect() for x in graph.subgraph(nodes, edges, "a", 1, max_nodes=10, max_paths=5))
    assert sorted((r["position"], r["id"], r["truncated"]) for r in cut) == [(k + 1, x, True) for k, x in enumerate("abcd")]
    assert sorted(r["edge_id"] for r in found) == ["e0", "e1", "e2", "e3", "e4", "e8", "e9"]
    whole, found = (x.collect() for x in graph.subgraph(nodes, edges, "a", 1, max_nodes=4, max_paths=10))
    assert len(whole) == 4 and len(found) == 10 and not any(r["truncated"] for r in whole)


def _every_walk(edges, start, hops):
    """All walks from a node that use no edge twice, one by one."""
    steps = [(e, a, b, r) for e, a, b, r in edges] + [(e, b, a, r) for e, a, b, r in edges if a != b]
    walks, out = [([start], [], [])], []
    for _ in range(hops):
        walks = [(n + [b], e + [i], r + [t]) for n, e, r in walks for i, a, b, t in steps if a == n[-1] and i not in e]
        out += walks
    return out


def test_walks_are_counted_without_being_listed(spark):
    """Neighbours and subgraphs against all walks, with loops, parallel edges and hidden nodes."""
    rng = random.Random(4)
    for size in (4, 7):
        rows = [(f"e{k:02d}", rng.choice("abcdefg"[:size]), rng.choice("abcdefg"[:size]), rng.choice(["PRODUCES", "SUPPLIES_TO"])) for k in range(14)]
        rows += [("l1", "a", "a", "PRODUCES"), ("l2", "a", "a", "PRODUCES"), ("p1", "a", "b", "PRODUCES"), ("p2", "b", "a", "SUPPLIES_TO")]
        edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, rel_type string")
        want = Counter((n[-1], ">".join(r)) for n, _, r in _every_walk(rows, "a", 3))
        assert {(r.neighbor, r.rels): r.paths for r in paths.supply_neighbors(edges, "a").collect()} == want
        nodes = spark.createDataFrame([(x, "Claim" if x in "bd" else "Company", x) for x in "abcdefg"], "id string, label string, canonical_name string")
        for most_nodes, most_walks in ((10, 6), (3, 1000)):
            walks = sorted(((len(e), n, e) for n, e, _ in _every_walk(rows, "a", 2) if n[-1] not in "bd"))
            seen = {}
            for walk in walks:
                for pos, x in enumerate(walk[1]):
                    seen.setdefault(x, (walk, pos))
            kept = sorted(seen, key=seen.get)[:most_nodes]
            got, found = (x.collect() for x in paths.subgraph(nodes, edges, "a", 2, most_nodes, most_walks))
            assert [r.id for r in sorted(got, key=lambda r: r.position)] == kept
            assert {r.truncated for r in got} == {len(seen) > most_nodes or len(walks) > most_walks}
            used = {e for w in [*walks[:most_walks], *(seen[x][0] for x in kept)] for e in w[2]}
            assert {r.edge_id for r in found} == {e for e, a, b, _ in rows if e in used and a in kept and b in kept}
        for limit in (1, 5):
            listed = sorted((len(e), n, e) for n, e, _ in _every_walk(rows, "a", 4) if n[-1] == "c")[:limit]
            got = paths.relation_paths(edges, "a", "c", 4, limit=limit).collect()
            assert [(r.hops, r.path_nodes, r.path_edges) for r in got] == listed


def test_states_fold_in_a_tree_of_small_groups(spark, at, monkeypatch):
    monkeypatch.setattr(folds, "WIDTH", 4)
    rng = random.Random(2)
    names = list(STATE_MACHINES["claim"])
    rows = [("hot", at(2024, 1, 1) + dt.timedelta(minutes=k // 3), k, rng.choice(names)) for k in range(300)]
    rows += [(f"e{k % 7}", at(2024, 1, 2), k, rng.choice(names)) for k in range(300, 340)]
    want, status, illegal = [], {}, Counter()
    for entity, _, event, target in sorted(rows):
        before = status.get(entity, "EXTRACTED")
        legal = target in STATE_MACHINES["claim"].get(before, ())
        want.append((entity, event, target, before, legal))
        status[entity] = target if legal else before
        illegal[entity] += not legal
    events = spark.createDataFrame(rows, "entity_id string, at timestamp_ntz, event_id int, to_status string").repartition(5)
    assert sorted(tuple(r) for r in folds.state_before(events, "claim", "EXTRACTED").collect()) == sorted(want)
    got = {r.entity_id: (r.final_status, r.illegal_moves) for r in folds.fold_states(events, "claim", "EXTRACTED").collect()}
    assert got == {e: (s, illegal[e]) for e, s in status.items()}
    assert folds.state_before(events.limit(0), "claim", "EXTRACTED").count() == 0


def test_neighbours_and_running_maximum_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(scaling, "BLOCK", 5)
    rng = random.Random(3)
    rows = [("hot", k, rng.randrange(100)) for k in range(33)] + [(f"k{k}", 1, k) for k in range(4)] + [("two", 1, 5), ("two", 2, 3)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(4)
    by_key = {}
    for k, o, v in sorted(rows):
        by_key.setdefault(k, []).append((o, v))
    lists = {(k, o): (x[i - 1][1] if i else None, x[i + 1][1] if i + 1 < len(x) else None, max((v for _, v in x[:i]), default=None))
             for k, x in by_key.items() for i, (o, _) in enumerate(x)}
    both = scaling.neighbour(scaling.neighbour(df, ["k"], ["o"], "v", "before"), ["k"], ["o"], "v", "after", ahead=True)
    assert {(r.k, r.o): (r.before, r.after) for r in both.collect()} == {x: y[:2] for x, y in lists.items()}
    top = scaling.running_max(df, ["k"], ["o"], "v", "top")
    assert {(r.k, r.o): r.top for r in top.collect()} == {x: y[2] for x, y in lists.items()}
    assert scaling.neighbour(df.limit(0), ["k"], ["o"], "v", "before").count() == 0
    hot = scaling.spread_join(df, spark.createDataFrame([("hot", 1), ("two", 2), ("none", 3)], "k string, w int"), ["k"], ["o"])
    assert Counter(r.k for r in hot.collect()) == {"hot": 33, "two": 2}


def test_claim_texts_are_not_sorted_for_their_digest(spark):
    """A version's digest is looked up; claims of a version without fragments keep a hash."""
    from factloom.operators.claims import claim_hash

    claims = spark.createDataFrame([("a", "one"), ("a", "two"), ("a", "one"), ("b", "one")], "document_version_id string, quote_text string")
    fragments = spark.createDataFrame([("a", "x"), ("a", "y")], "document_version_id string, checksum string")
    hints = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hints}
    try:
        for k, v in hints.items():
            spark.conf.set(k, v)
        hashed = claim_hash(claims, fragments)
        plan = hashed._jdf.queryExecution().executedPlan().toString()
        rows = hashed.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    assert len(rows) == 4 and len({r["content_hash"] for r in rows}) == 3
