import csv
import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.config import Settings, load
from veilframe.errors import BudgetError, PolicyError, RiskError, VeilError
from veilframe.functions.laplace import Ledger, Noise, draw
from veilframe.operators.kanon import enforce
from veilframe.operators.preflight import preflight
from veilframe.plans import engine, report
from veilframe.plans.policy import Policy, Request, catalog, derived_key, suggest, suggested_request
from veilframe.store import Store

S = Settings()


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(f"p{i}@x.org", ["10001", "10002"][i % 2], 20 + i % 3, 1000.0 * i) for i in range(30)], "email string, zip string, age int, salary double")


def test_null_is_a_class(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [("10001", i) for i in range(3)], "zip string, n int")
    out = enforce(df, ["zip"], 4)
    assert (out.rows_total, out.rows_suppressed, out.classes_below_k, out.k_achieved) == (8, 3, 1, 5)
    assert {r.zip for r in out.df.collect()} == {None}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)] * 3, "size int, q0 int, row int, d0 int")
    assert enforce(df, ["q0", "size"], 2).df.collect() == df.collect()


def test_diversity(spark):
    rows = [("a", "flu")] * 4 + [("b", x) for x in ("flu", "cold", None, "flu")]
    df = spark.createDataFrame(rows, "zip string, disease string")
    one, two = enforce(df, ["zip"], 2, ["disease"]), enforce(df, ["zip"], 2, ["disease"], 2)
    assert one.df.count() == 8 and one.homogeneous == {"disease": 1}
    assert two.df.count() == 4 and two.classes_below_l == 1 and two.l_achieved == {"disease": 1}


def test_degenerate(spark):
    df = spark.createDataFrame([], "zip string")
    assert enforce(df, [], 2).k_achieved == 0
    assert enforce(df, ["zip"], 2).rows_total == 0
    for bad in ((["zip"], 1), (["nobody"], 2)):
        with pytest.raises(PolicyError):
            enforce(df, *bad)
    with pytest.raises(PolicyError):
        enforce(df, ["zip"], 2, ["zip"])


def test_preflight_finds_the_worst(spark):
    df = spark.createDataFrame([("ab"[i % 2], str(i), "xyz"[i % 3]) for i in range(60)], "city string, zip string, tier string")
    found = preflight(df, ["city", "zip", "tier"], 5)
    assert found["drop_one"][0].column == "zip" and found["plan"]["columns"] == ["zip"] and found["plan"]["reaches_target"]
    multi = spark.createDataFrame([(c, t, i % 7, i % 8) for c in "ab" for t in "xy" for i in range(28)], "city string, tier string, team int, level int")
    found = preflight(multi, ["city", "tier", "team", "level"], 5)
    assert found["ratio"] == 1.0 and found["plan"]["columns"] == ["level", "team"] and found["plan"]["final_ratio"] == 0.0
    with pytest.raises(PolicyError):
        preflight(spark.range(1).select(*[F.lit(1).alias(f"c{i}") for i in range(16)]), [f"c{i}" for i in range(16)], 2)


def test_laplace():
    x = draw(20_000, 3.0)
    assert abs(np.median(x)) < 0.2 and abs(np.abs(x).mean() - 3.0) < 0.2 and np.isfinite(x).all()
    for bad in ((0, 0, 1), (1, 1, 1), (math.inf, 0, 1)):
        with pytest.raises(PolicyError):
            Noise(*bad)


def noisy(**more):
    ps = (Policy("email", "drop"), Policy("salary", "dp_laplace"), Policy("zip", is_quasi_identifier=True))
    return Request(ps, k=5, dp={"salary": {"epsilon": 1.0, "lower": 0, "upper": 20000} | more})


def test_noise_is_drawn_once(people):
    out = engine.release(people, noisy(), S)
    a, b = ([r.salary for r in out.df.orderBy("zip", "age", "salary").collect()] for _ in range(2))
    assert a == b and all(0 <= x <= 20000 for x in a)
    assert out.spent == {"salary": 1.0}


def test_budget_is_checked_before(people):
    with pytest.raises(BudgetError):
        engine.release(people, noisy(), S, spent={"salary": 9.5})
    for bad in ({"epsilon": 99}, {"lower": None}, {"epsilon": "x"}):
        with pytest.raises(PolicyError):
            engine.release(people, noisy(**bad), S)
    ledger = Ledger(2.0)
    ledger.commit({"a": 1.0})
    ledger.commit({"a": 1.0})
    with pytest.raises(BudgetError):
        ledger.commit({"a": 0.1})
    assert ledger.greatest == 2.0


def test_guardrails(spark):
    df = spark.createDataFrame([(c,) for c in "AAAAAABBBBBBCD"], "dept string")
    req = Request((Policy("dept", is_quasi_identifier=True),), k=5)
    with pytest.raises(RiskError):
        engine.release(df, req, S)
    assert engine.release(df, replace(req, accept_weaker=True), S).df.count() == 12
    unique = spark.createDataFrame([(str(i),) for i in range(20)] + [("x",)] * 5, "z string")
    with pytest.raises(RiskError):
        engine.release(unique, Request((Policy("z", is_quasi_identifier=True),), k=5, accept_weaker=True), S)


def test_report_keeps_the_input_to_itself(people):
    ps = (Policy("email", "hash"), Policy("zip", "string_truncate", {"keep": 3}, True), Policy("age", "numeric_bin", {"bin_width": 10}, True))
    out = engine.release(people, Request(ps, k=5), S)
    found = json.loads(report.to_json(out.report))
    assert "@" not in json.dumps(found) and found["k_anonymity"]["k_achieved"] >= 5
    assert all(set(e) == {"name", "dtype", "kind"} for e in found["schema"])
    assert "distinct_before" not in json.dumps(found)
    text = report.to_markdown(out.report)
    assert "# Release" in text and report.escape("a|b`c") == "a\\|b\\`c"


def test_homogeneous_warning(spark):
    df = spark.createDataFrame([("a", "flu")] * 6 + [("b", str(i)) for i in range(6)], "zip string, disease string")
    out = engine.release(df, Request((Policy("zip", is_quasi_identifier=True),), k=5), S)
    assert any("disease" in w for w in out.report["warnings"])


def test_preview_draws_no_noise(people):
    rows = engine.preview(people, noisy(), S)
    assert len(rows) == 5 and {r["salary"] for r in rows} == {"(noised)"} and "email" not in rows[0]
    with pytest.raises(PolicyError):
        engine.preflight(people, Request((Policy("salary", "dp_laplace", is_quasi_identifier=True),)), S)
    assert engine.preflight(people, noisy(), S)["rows_suppressed"] == 0
    assert engine.shown("x" * 100) == "x" * 77 + "…" and engine.shown(1 / 3) == "0.333333"


def test_settings_and_keys():
    assert load({}).k == 5 and not load({}).salt_is_lasting
    kept = load({"VEILFRAME_SALT": "ab" * 32, "VEILFRAME_K": "7"})
    assert kept.k == 7 and derived_key(kept, "a", ()) == derived_key(kept, "a", ()) != derived_key(kept, "b", ())
    for bad in ({"K": "1"}, {"K": "x"}, {"EPSILON_MIN": "20"}, {"SOFT_CAP": "0.6"}, {"EPSILON_BUDGET": "0"}, {"ORIGINS": "*"}, {"SALT": "zz"}):
        with pytest.raises(VeilError):
            load({f"VEILFRAME_{k}": v for k, v in bad.items()})
    with pytest.raises(PolicyError):
        derived_key(S, "a", ())
    with pytest.raises(PolicyError):
        derived_key(kept, "a", (Policy("x", "dp_laplace"),))
    for bad in ({"k": 1}, {"l": 0}, {"policies": [{}]}, {"policies": [{"column": "a", "action": "fly"}]}):
        with pytest.raises(PolicyError):
            Request.from_dict(bad)


def test_suggestions(tmp_path):
    entry = {"name": "Salary", "kind": "numeric", "n_unique": 3, "row_count": 100, "min": 1.0, "max": 9.0}
    assert suggest(entry, "none", 5) == {"column": "Salary", "action": "retain", "params": {}, "is_quasi_identifier": True, "source": "kind"}
    assert suggest(entry, "email", 5)["action"] == "hash"
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"fields": {"salary": {"action": "dp_laplace"}}}))
    found = suggest(entry, "email", 5, catalog(str(file)))
    assert (found["action"], found["source"], found["dp_params"]["upper"], found["bounds_from_data"]) == ("dp_laplace", "field", 9.0, True)
    file.write_text("[")
    with pytest.raises(VeilError):
        catalog(str(file))


def test_auto_request(spark, people):
    from veilframe.operators.profile import detect, schema_profile

    req = suggested_request(schema_profile(people), detect(people), 5)
    assert {p.column: p.action for p in req.policies}["email"] == "hash"


def test_store(people):
    now = [0.0]
    store = Store(10, 2.0, lambda: now[0])
    a = store.create(people)
    store.begin(a)
    with pytest.raises(VeilError):
        store.begin(a)
    store.finish(a, "out", {"x": 1}, {"salary": 1.5})
    assert store.get(a).report == {"x": 1} and store.get(a).ledger.spent == {"salary": 1.5}
    key = store.get(a).key
    now[0] = 11
    with pytest.raises(VeilError):
        store.get(a)
    assert store.sweep() == 1 and not any(key) and not len(store) and not store.delete(a)


def test_summary_is_the_single_operators(people):
    from veilframe.operators.profile import correlations, histogram, numeric_stats, summary

    stats, pairs, bars = summary(people, ["age", "salary"])
    assert stats == numeric_stats(people, ["age", "salary"]).collect() and pairs == correlations(people, ["age", "salary"]).collect()
    for c in ("age", "salary"):
        assert bars[c] == [[r.lower, r.upper, r.n] for r in histogram(people, c).orderBy("bin").collect()]


def test_service(spark, people, tmp_path):
    from veilframe.service import Service

    service = Service(spark, str(tmp_path), S)
    opened = service.open(people)
    name = opened["session"]
    assert {p["column"]: p["action"] for p in opened["policies"]}["email"] == "hash"
    request = {"policies": [{"column": "email", "action": "drop"}, {"column": "salary", "action": "dp_laplace"}, {"column": "zip", "is_quasi_identifier": True}], "dp_params": {"salary": {"epsilon": 6.0, "lower": 0, "upper": 9}}}
    assert len(service.preview(name, request)) == 5 and service.preflight(name, request)["ratio"] == 0.0
    with pytest.raises(VeilError):
        service.download(name)
    report_ = service.process(name, request)
    assert report_["privacy"]["cumulative_epsilon"] == {"salary": 6.0} and service.store.get(name).ledger.spent == {"salary": 6.0}
    assert len(open(service.download(name)).read().splitlines()) == 31 and "# Release" in service.download(name, "markdown")
    with pytest.raises(BudgetError):
        service.process(name, request)
    with pytest.raises(VeilError):
        service.download(name, "json")
    assert service.health()["sessions"] == 1 and service.delete(name) and not service.delete(name)


def test_what_is_spent_lasts(people, tmp_path):
    from veilframe.functions.laplace import Ledger

    path = str(tmp_path / "ledger.json")
    Ledger(2.0, path=path).commit({"a": 1.5})
    again = Ledger(2.0, path=path)
    assert again.spent == {"a": 1.5}
    with pytest.raises(BudgetError):
        again.commit({"a": 1.0})
    assert Ledger(2.0, path=path).spent == {"a": 1.5}
    (tmp_path / "ledger.json").write_text("no")
    with pytest.raises(BudgetError):
        Ledger(2.0, path=path)
    store = Store(100, 2.0, folder=str(tmp_path))
    one, two, other = store.create(people, "d"), store.create(people, "d"), store.create(people)
    store.get(one).ledger.commit({"a": 2.0})
    assert store.get(two).ledger.spent == {"a": 2.0} and not store.get(other).ledger.spent
    restarted = Store(100, 2.0, folder=str(tmp_path))
    assert restarted.get(restarted.create(people, "d")).ledger.spent == {"a": 2.0}


def test_rules_are_merged_within(tmp_path):
    p = tmp_path / "rules.json"
    p.write_text('{"defaults": {"by_pii_kind": {"phone": {"action": "mask", "params": {"keep_prefix": 4}}, "email": {"is_quasi_identifier": true}}}}')
    rules = catalog(str(p))["defaults"]["by_pii_kind"]
    assert rules["phone"]["params"] == {"keep_prefix": 4, "keep_suffix": 1} and rules["email"] == {"action": "hash", "is_quasi_identifier": True}
    for bad in ('{"fields": {"a": 1}}', '{"fields": {"a": {"action": "burn"}}}', '{"defaults": []}', '{"fields": {"a": {"params": 3}}}'):
        p.write_text(bad)
        with pytest.raises(VeilError):
            catalog(str(p))


def test_offered_parameters():
    from veilframe.plans.policy import offered_params

    assert offered_params("numeric_bin", lower=0, upper=50) == {"bin_width": 5.0} and offered_params("numeric_bin") == {"bin_width": 1}
    assert offered_params("numeric_bin", {"bin_width": 3}, 0, 50) == {"bin_width": 3}
    assert offered_params("mask") == {"keep_prefix": 1, "keep_suffix": 1} and offered_params("mask", {"keep_prefix": 0, "mask_char": "#"}) == {"keep_prefix": 0, "keep_suffix": 1, "mask_char": "#"}
    assert offered_params("string_truncate") == {"keep": 3} and offered_params("date_truncate", {"granularity": "year"}) == {"granularity": "year"}
    assert offered_params("redact") == {} and offered_params("redact", {"replacement": "x"}) == {"replacement": "x"} and offered_params("retain") == {}


def test_epsilon_of_the_settings_is_suggested():
    entry = {"name": "x", "kind": "numeric", "n_unique": 3, "row_count": 9, "min": 0.0, "max": 5.0}
    rules = {"fields": {"x": {"action": "dp_laplace"}}}
    assert suggest(entry, "none", 5, rules, 0.25)["dp_params"] == {"epsilon": 0.25, "lower": 0.0, "upper": 5.0}


def test_preflight_of_diversity_is_brute_force(spark):
    import random

    from veilframe.operators.preflight import preflight

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.choice("xyz"), rng.choice("pq"), rng.choice([None, 1, 2])) for _ in range(160)]
    df = spark.createDataFrame(rows, "a string, b int, c string, s string, t int")
    qis = ["a", "b", "c"]

    found = preflight(df, qis, 6, ["s", "t"], 2)
    from veilframe.operators.kanon import value_table
    from veilframe.operators.preflight import drop_each_diverse

    got = {r.left_out: r.rows_suppressed for r in drop_each_diverse([value_table(df, qis, c) for c in ("s", "t")], qis, [0, 1, 2], 6, 2).collect()}
    two = lambda g: len({r[3] for r in g}) < 2 or len({r[4] for r in g}) < 2
    want = {}
    for out in qis:
        at, groups = [qis.index(c) for c in qis if c != out], {}
        for r in rows:
            groups.setdefault(tuple(r[i] for i in at), []).append(r)
        want[out] = sum(len(g) for g in groups.values() if len(g) < 6 or two(g))
    assert got == want == {s.column: s.rows_suppressed for s in found["drop_one"]}


def test_comparison_of_both_tables(spark):
    from veilframe.plans.engine import validation

    before = spark.createDataFrame([(1.0, "a", 1), (2.0, None, 2)], "x double, s string, gone int")
    after = before.selectExpr("cast(x as string) as x", "s")
    found = validation(before, after)
    assert found["columns"]["x"]["kind"] == "numeric" and found["columns"]["x"]["after_kind"] == "categorical"
    assert found["columns"]["s"]["after"] == {"kind": "categorical", "n_unique": 1, "null_ratio": 0.5}
    assert found["columns"]["gone"]["dropped"] and found["columns"]["gone"]["after"] is None
    assert (found["rows_before"], found["rows_after"], len(found["correlation_before"])) == (2, 2, 3)
    none = validation(before, after.where("false"))
    assert none["rows_after"] == 0 and none["correlation_after"] == []


def test_two_ledgers_on_one_log(spark, tmp_path):
    """Of two releases of 2.0 on a budget of 3.0, one is refused before anything is drawn."""
    from veilframe.functions import ledger as module

    for path in (str(tmp_path / "local"), f"file://{tmp_path}/shared"):
        if "shared" in path:
            make = lambda: module.Ledger(3.0, path=path)  # noqa: E731, B023
            old, module._log = module._log, lambda p: module._Shared(p, spark)
        else:
            make, old = lambda: Ledger(3.0, path=path), None  # noqa: E731, B023
        try:
            one, two = make(), make()
            token = one.reserve({"a": 2.0})
            with pytest.raises(BudgetError):
                two.reserve({"a": 2.0})
            assert two.spent == {"a": 2.0}  # reserved counts as spent
            one.abort(token)
            two.settle(two.reserve({"a": 2.0}))
            with pytest.raises(BudgetError):
                one.commit({"a": 2.0})
            one.commit({"a": 1.0, "b": 3.0})
            assert make().spent == {"a": 3.0, "b": 3.0} == two.after({})
        finally:
            if old:
                module._log = old


_SPENDER = """
import sys
from veilframe.errors import BudgetError
from veilframe.functions.ledger import Ledger
done = 0
for k in range(40):
    try:
        Ledger(30.0, path=sys.argv[1]).commit({"a": 1.0})
        done += 1
    except BudgetError:
        pass
print(done)
"""


def test_many_processes_never_overspend(tmp_path):
    import subprocess
    import sys

    runs = [subprocess.Popen([sys.executable, "-c", _SPENDER, str(tmp_path / "led")], stdout=subprocess.PIPE, text=True) for _ in range(3)]
    done = [int(r.communicate(timeout=300)[0]) for r in runs]
    assert sum(done) == 30 and Ledger(30.0, path=str(tmp_path / "led")).spent == {"a": 30.0}


def test_a_release_that_fails_gives_back_what_it_reserved(people, tmp_path):
    ledger = Ledger(3.0, path=str(tmp_path / "led"))
    request = Request((Policy("salary", "dp_laplace"), Policy("zip", is_quasi_identifier=True)), k=1000, dp={"salary": {"epsilon": 2.0, "lower": 0, "upper": 9}})
    with pytest.raises(VeilError):
        engine.release(people, request, S, ledger=ledger)
    assert ledger.spent == {}
    found = engine.release(people, Request(request.policies, k=2, dp=request.dp), S, ledger=ledger)
    ledger.settle(found.token)
    assert Ledger(3.0, path=str(tmp_path / "led")).spent == {"salary": 2.0}


def test_distinct_counts_of_all_kinds(spark):
    """In one shuffle without a copy of the rows for each column; the counts of plain Python."""
    from veilframe.operators.distinct import counted, counts
    from veilframe.operators.profile import detect, detection_sample, schema_profile

    nan = float("nan")
    rows = [(1, 0.0, "a", [1], {"x": 1}, None), (1, -0.0, "A", [1], {"x": 1}, None), (None, nan, None, None, None, None), (3, nan, "a", [], {"x": 2}, None), (2**60, 1.5, "", [1, None], {"y": 1}, None)] * 3
    df = spark.createDataFrame(rows, "k long, v double, `s. t` string, a array<int>, m map<string,int>, z string")
    got = {c: (n.distinct, n.nulls, n.rows) for c, n in counted(df, df.columns).items()}
    assert got == {"k": (4, 3, 15), "v": (3, 0, 15), "s. t": (4, 3, 15), "a": (4, 3, 15), "m": (4, 3, 15), "z": (1, 15, 15)}
    assert counted(df, ["v"])["v"].high == 1.5 and counted(df.limit(0), ["k"])["k"].rows == 0
    assert {c: n.distinct for c, n in counted(df, ["k", "v"], exact=False).items()} == {"k": 4, "v": 3}
    assert [e["n_unique"] for e in schema_profile(df)] == [4, 3, 4, 4, 4, 1] and detect(detection_sample(df, 4))["k"]
    plan = counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 2  # values by hash, then a row a column
    plan = detection_sample(df.select("k", "`s. t`"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Python" not in plan


def test_detection_reads_all_of_a_table_within_its_limit(spark, sf, tmp_path):
    """Twelve thousand suppliers are all read, and no task sorts them."""
    from veilframe.operators.profile import detection_sample
    from veilframe.plans.queries import queries

    spark.range(12_000).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in queries()["detection_rows"](spark, str(tmp_path)).collect()] == [(1000, 12_000, 0)]
    assert "TakeOrdered" not in detection_sample(spark.range(50), 50)._jdf.queryExecution().executedPlan().toString()
    assert detection_sample(spark.range(51), 50).count() == 50


def test_one_file_is_written_by_many_tasks(spark, tmp_path):
    """Parts in the order of rows behind one header, whatever the names of columns are."""
    from veilframe.sinks import write_csv

    df = spark.range(0, 5000, 1, 7).select("id", F.concat(F.lit('a, "b"\n'), "id").alias('na"me, x'), F.when(F.col("id") % 2 == 0, F.col("id")).alias("h"))
    path = write_csv(df, str(tmp_path / "one.csv"))
    with open(path, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["id", 'na"me, x', "h"] and [r[0] for r in rows[1:]] == [str(k) for k in range(5000)]
    assert rows[3] == ["2", 'a, "b"\n2', "2"] and rows[2][2] == ""
    write_csv(df.limit(0), path)
    assert open(path).read() == 'id,"na""me, x",h\n' and [p.name for p in tmp_path.iterdir() if p.name.startswith("one")] == ["one.csv"]
