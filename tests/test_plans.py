"""Plan schema rules, validation joins, first violation and attempt resolution."""

import json
from functools import reduce

from pyspark.sql import functions as F

from flagtide.plans import validate as V
from flagtide.plans.grounding import quotes_in_texts


def _ev(source="business_context", quote="Owner says OLD_FLAG is on", explanation="why"):
    return {"source": source, "quote": quote, "explanation": explanation}


def _target(flag="OLD_FLAG", state=True, files=("app.py",), evidence=None, **extra):
    t = {"flag_name": flag, "final_state": state, "files_affected": list(files),
         "evidence": evidence if evidence is not None else [_ev()]}
    t.update(extra)
    return t


def attempts_df(spark, plans):
    rows = [("r1", i + 1, "completed", None, p if isinstance(p, str) else json.dumps(p))
            for i, p in enumerate(plans)]
    return spark.createDataFrame(rows, "repo_id string, attempt int, status string, error string, payload string")


def facts(spark):
    cands = spark.createDataFrame(
        [("r1", "OLD_FLAG", ["app.py"], [("app.py", 1, "if_statement", "   1: if OLD_FLAG:")])],
        "repo_id string, flag_name string, files array<string>, "
        "occurrences array<struct<file_path:string,line:int,kind:string,snippet:string>>")
    allow = spark.createDataFrame([("r1", "app.py"), ("r1", "other.py")], "repo_id string, path string")
    ctx = spark.createDataFrame([("r1", "  Owner says OLD_FLAG is on\n")], "repo_id string, text string")
    return cands, allow, ctx


def first_rules(spark, plans):
    p, t = V.parse_plans(attempts_df(spark, plans))
    cands, allow, ctx = facts(spark)
    f = V.first_violation(V.all_violations(p, t, cands, allow, ctx))
    got = {r.attempt: r.rule for r in f.collect()}
    return [got.get(i + 1) for i in range(len(plans))]


def test_schema_rules(spark):
    plans = [
        {"targets": [_target()]},                                   # valid
        {"targets": [_target(state="true")]},                       # strict bool
        {"targets": [_target(note="x")]},                           # extra field
        {"targets": [_target(evidence=[_ev(source="repository", quote="if OLD_FLAG")])]},  # no business item
        {"targets": [_target(files=("app.py", " app.py"))]},        # duplicate after strip
        {"targets": [_target(), _target()]},                        # duplicate flag
        {"targets": []},                                            # empty plan is valid
        {"targets": [_target()], "extra": 1},                       # extra plan key
    ]
    assert first_rules(spark, plans) == [None, "schema", "schema", "schema", "schema", "schema", None, "schema"]


def test_malformed_payloads_are_rows_not_failures(spark):
    bad = ['{"targets": "x"}', '{"targets": [1, null, "y", [2]]}', '[1]', '"text"', "12", "not json", "null", "{}",
           json.dumps({"targets": [_target(state="maybe")]}), json.dumps({"targets": [_target(files="a.py")]}).replace('["a", ".", "p", "y"]', '"a.py"'),
           json.dumps({"targets": [_target(flag=123)]}), json.dumps({"targets": [_target(files=(1, 2))]}),
           json.dumps({"targets": [_target(evidence="e")]}), json.dumps({"targets": [_target(evidence=[5, None])]}),
           json.dumps({"targets": [_target(evidence=[_ev(quote=7)])]}), json.dumps({"targets": [_target(flag=" " * 3)]}),
           json.dumps({"targets": [_target(evidence=[_ev(quote="  "), _ev()])]}), json.dumps({"targets": [_target(flag="A" * 201)]})]
    assert first_rules(spark, bad) == ["schema"] * len(bad)


def test_fields_are_stripped_before_the_joins(spark):
    padded = _target(flag=" OLD_FLAG\t", files=("\tapp.py ",), evidence=[_ev(quote="  Owner says OLD_FLAG is on ")])
    assert first_rules(spark, [{"targets": [padded]}, {"targets": [padded, _target()]}]) == [None, "schema"]


def test_verdicts_of_missing_and_malformed_payloads(spark):
    from flagtide.plans.discovery import attempt_verdicts

    rows = [("r1", 1, "completed", None, None), ("r1", 2, "completed", None, "[]"), ("r1", 3, "incomplete", None, "{}"),
            ("r1", 4, "completed", None, json.dumps({"targets": [_target()]}))]
    df = spark.createDataFrame(rows, "repo_id string, attempt int, status string, error string, payload string")
    got = {r.attempt: r.outcome for r in attempt_verdicts(df, *facts(spark)).collect()}
    assert got == {1: "fatal", 2: "invalid", 3: "fatal", 4: "valid"}


def test_one_pass_equals_the_single_joins(spark):
    plans = [{"targets": [_target(flag="NEW_FLAG", files=("a.txt", "other.py", "gone.py")), _target(files=("x\\app.py", "app.py", "./app.py"))]},
             {"targets": [_target(files=("other.py", "other.py "), evidence=[_ev(quote="?"), _ev(source="repository", quote="if OLD_FLAG")])]}]
    _, t = V.parse_plans(attempts_df(spark, plans))
    cands, allow, ctx = facts(spark)
    files = V.target_files(t)
    got = sorted((r.attempt, r.ordinal, r.rule) for r in V.semantic_violations(t, cands, allow, ctx).collect())
    key = lambda df, rule: [(r.attempt, r.ordinal, rule) for r in df.collect()]
    want = sorted(key(V.join_unknown_flags(t, cands), "unknown_flag") + key(V.bad_paths(files), "bad_path")
                  + key(V.dup_paths(files), "duplicate_path") + key(V.join_hallucinated_paths(files, allow), "hallucinated_path")
                  + key(V.join_unrelated_paths(files, allow, cands).select(*V.TARGET_KEY, "path").distinct(), "unrelated_path")
                  + key(V.join_omitted_paths(t, files, cands), "omitted_path")
                  + key(V.join_evidence_grounding(t, ctx, cands), "ungrounded_evidence"))
    assert got == want


def test_semantic_rules_in_order(spark):
    plans = [
        {"targets": [_target(flag="NEW_FLAG")]},                    # unknown flag
        {"targets": [_target(files=("../app.py",))]},               # unsafe path
        {"targets": [_target(files=("app.py", "app\\\\py"))]},      # not python after normalise
        {"targets": [_target(files=("missing.py",))]},              # hallucinated
        {"targets": [_target(files=("app.py", "other.py"))]},       # unrelated
        {"targets": [_target(files=("app.py",), evidence=[_ev(quote="nobody said this")])]},  # ungrounded
    ]
    plans[2]["targets"][0]["files_affected"] = ["app.py", "app\\sub.txt"]
    assert first_rules(spark, plans) == ["unknown_flag", "bad_path", "bad_path", "hallucinated_path",
                                         "unrelated_path", "ungrounded_evidence"]


def test_omitted_and_duplicate_normalised_paths(spark):
    cands = spark.createDataFrame(
        [("r1", "OLD_FLAG", ["a/x.py", "b.py"], [("a/x.py", 1, "if_statement", "s")])],
        "repo_id string, flag_name string, files array<string>, "
        "occurrences array<struct<file_path:string,line:int,kind:string,snippet:string>>")
    _, t = V.parse_plans(attempts_df(spark, [{"targets": [_target(files=("a/x.py", "a\\x.py"))]}]))
    f = V.target_files(t)
    assert [(r.path, r.n) for r in V.dup_paths(f).collect()] == [("a/x.py", 2)]
    assert [r.path for r in V.join_omitted_paths(t, f, cands).collect()] == ["b.py"]


def test_resolve_attempts(spark):
    rows = [("a", 1, "invalid", "e1"), ("a", 2, "valid", None),       # retry then accept
            ("b", 1, "invalid", "e1"), ("b", 2, "invalid", "e2"),      # exhausted, last error
            ("c", 1, "fatal", "boom"), ("c", 2, "valid", None),        # fatal: no retry
            ("d", 1, "valid", None),
            ("e", 1, "invalid", "x"), ("e", 2, "invalid", "y"), ("e", 3, "valid", None),  # only 2 count
            ("f", 2, "invalid", "z"), ("f", 7, "valid", None),         # numbers with gaps
            ("g", 9, "valid", None), ("h", 4, "fatal", "h4"), ("i", 5, "invalid", "i5"), ("i", 3, "invalid", "i3")]
    df = spark.createDataFrame(rows, "k string, n int, outcome string, err string")
    got = {r.k: (r.resolution, r.used_n, r.attempts_used, r.error)
           for r in V.resolve_attempts(df, "k", ["n"], "outcome", "err", 2).collect()}
    assert got == {"a": ("accepted", 2, 2, None), "b": ("exhausted", 2, 2, "e2"), "c": ("fatal", 1, 1, "boom"),
                   "d": ("accepted", 1, 1, None), "e": ("exhausted", 2, 2, "y"), "f": ("accepted", 7, 2, None),
                   "g": ("accepted", 9, 1, None), "h": ("fatal", 4, 1, "h4"), "i": ("exhausted", 5, 2, "i5")}


def test_accepted_plan_is_that_of_its_own_attempt(spark):
    """Attempts 2 (rejected) and 3 (accepted) of one repository, and only attempt 5 of another."""
    from flagtide.plans.discovery import accepted_targets

    wrong, right = {"targets": [_target(flag="NEW_FLAG")]}, {"targets": [_target(state=False)]}
    rows = [("r1", 2, wrong), ("r1", 3, right), ("r2", 5, {"targets": [_target()]}), ("r3", 4, wrong)]
    df = spark.createDataFrame([(r, n, "completed", None, json.dumps(p)) for r, n, p in rows],
                               "repo_id string, attempt int, status string, error string, payload string")
    cands, allow, ctx = ([x.withColumn("repo_id", F.lit(r)) for r in ("r1", "r2", "r3")] for x in facts(spark))
    union = lambda dfs: reduce(type(df).unionByName, dfs)
    resolved, targets = accepted_targets(df, union(cands), union(allow), union(ctx))
    assert {(r.repo_id, r.resolution, r.used_attempt) for r in resolved.collect()} == {
        ("r1", "accepted", 3), ("r2", "accepted", 5), ("r3", "exhausted", 4)}
    assert sorted(map(tuple, targets.collect())) == [("r1", "OLD_FLAG", False, "app.py"), ("r2", "OLD_FLAG", True, "app.py")]


def test_a_plan_of_very_many_paths_is_rejected_in_linear_time(spark):
    import time

    def seconds(n):
        plan = {"targets": [_target(files=[f"d/{i % (n - 1)}.py" for i in range(n)], evidence=[_ev()] * 30)]}
        df = attempts_df(spark, [plan])
        at = time.perf_counter()
        p, t = V.parse_plans(df)
        first = V.first_violation(V.all_violations(p, t, *facts(spark))).collect()
        assert [r.rule for r in first] == ["schema"]
        return time.perf_counter() - at

    seconds(1_000)
    assert seconds(100_000) < seconds(10_000) * 10 + 10


def test_repeated_values_by_neighbours(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],), (["x"],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(V.repeated_values(F.col("v"))).collect()] == [["a", "b"], [], [], None]


def test_keyless_grounding_is_exact(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "xbeta gamma delta epsilony"),
                                   (3, "nothing here")], "tid int, text string")
    quotes = spark.createDataFrame([(10, "ta gamma delta epsil"), (11, "beta gamma"), (12, "eta"),
                                    (13, "alpha beta gamma delta epsilon zeta"), (14, "gamma  delta")],
                                   "qid int, quote string")
    got = sorted((r.qid, r.tid) for r in quotes_in_texts(quotes, texts, "qid", "quote", "tid", "text").collect())
    rows_t = [(1, "alpha beta gamma delta epsilon zeta"), (2, "xbeta gamma delta epsilony"), (3, "nothing here")]
    rows_q = [(10, "ta gamma delta epsil"), (11, "beta gamma"), (12, "eta"),
              (13, "alpha beta gamma delta epsilon zeta"), (14, "gamma  delta")]
    brute = sorted((q, t) for q, qs in rows_q for t, ts in rows_t if qs in ts)
    assert got == brute


def test_grounding_of_many_short_quotes(spark):
    """One- and two-word quotes have no interior word: character anchors find them."""
    import itertools

    texts = [(i, "".join(t)) for i, t in enumerate(itertools.product(["ab cd", "bc", "é x", "long wording"], repeat=3))]
    quotes = [(i, q) for i, q in enumerate(["a", "b c", "bcab", "cd", "é xbc", "wordinglong", "dlong wo", "zz", "", " ", "g", None])]
    df = quotes_in_texts(spark.createDataFrame(quotes, "qid int, quote string"),
                         spark.createDataFrame(texts, "tid int, text string"), "qid", "quote", "tid", "text")
    assert sorted(map(tuple, df.collect())) == sorted((q, t) for q, qs in quotes for t, ts in texts if qs and qs in ts)


def test_prompt_length_is_counted_before_assembly(spark):
    from flagtide.plans.discovery import prompt_table

    cands, _, ctx = facts(spark)
    p = prompt_table(cands, ctx).collect()[0]
    assert p.prompt_chars == len(p.prompt) and not p.too_long
    assert p.prompt.startswith("BUSINESS CONTEXT:\nOwner says OLD_FLAG is on\n\nCANDIDATES:\nFLAG OLD_FLAG")
    assert "RULES FOR THE ANSWER" in p.prompt and p.attempt == 1
    rejected = spark.createDataFrame([("r1", 1, "unknown flag: X")], "repo_id string, attempt int, error string")
    again = prompt_table(cands, ctx, rejections=rejected).where("attempt = 2").collect()[0]
    assert again.prompt.startswith(p.prompt) and "Because: unknown flag: X" in again.prompt
    assert again.prompt_chars == len(again.prompt)
    small = prompt_table(cands, ctx, max_chars=10).collect()[0]
    assert small.too_long and small.prompt is None and small.prompt_chars == p.prompt_chars


def test_attempt_limit_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i, "invalid", "e") for i in range(10)], "k string, n int, outcome string, err string")
    plan = V.resolve_attempts(df, "k", ["n"], "outcome", "err", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_repository_quote_may_span_two_snippets(spark):
    cands = spark.createDataFrame(
        [("r1", "OLD_FLAG", ["a.py", "b.py"], [("a.py", 1, "if_statement", "   1: if OLD_FLAG:"),
                                               ("b.py", 3, "if_statement", "   3: if OLD_FLAG:")])],
        "repo_id string, flag_name string, files array<string>, "
        "occurrences array<struct<file_path:string,line:int,kind:string,snippet:string>>")
    _, _, ctx = facts(spark)
    evidence = [_ev(), _ev(source="repository", quote="if OLD_FLAG:\n   3: if"), _ev(source="repository", quote="nope")]
    _, t = V.parse_plans(attempts_df(spark, [{"targets": [_target(files=("a.py", "b.py"), evidence=evidence)]}]))
    bad = [(r.ev_ordinal, r.quote) for r in V.join_evidence_grounding(t, ctx, cands).collect()]
    assert bad == [(3, "nope")]


def test_grounding_with_no_quotes(spark):
    texts = spark.createDataFrame([(1, "alpha beta")], "tid int, text string")
    quotes = spark.createDataFrame([], "qid int, quote string")
    out = quotes_in_texts(quotes, texts, "qid", "quote", "tid", "text")
    assert out.columns == ["qid", "tid"] and out.count() == 0


def test_quotes_are_anchored_on_what_is_rare(spark):
    """A phrase of every text at the start of a quote makes no candidates."""
    from flagtide.plans.grounding import candidate_pairs

    texts = spark.createDataFrame(
        [(i, f"as said in the notes, {'the owner of part ' + str(i) + ' signs it off' if i < 7 else 'nobody signs ' + str(i)} today")
         for i in range(300)], "tid int, text string")
    quotes = spark.createDataFrame([(1, "as said in the notes, the owner of part 3 signs it"), (2, "in the notes, the owner of"),
                                    (3, "as said in the notes, nothing else"), (4, "notes, t"), (5, "s, no"), (6, "a")],
                                   "qid int, quote string")
    pairs = candidate_pairs(quotes, texts, "qid", "quote", "tid", "text")
    per_quote = {r.qid: r["count"] for r in pairs.groupBy("qid").count().collect()}
    # three words of quote 1 stand in one text only, and quote 3 has words that stand nowhere
    assert per_quote == {1: 1, 2: 7, 4: 7, 5: 293, 6: 300}
    got = sorted(map(tuple, quotes_in_texts(quotes, texts, "qid", "quote", "tid", "text").collect()))
    rows = texts.collect()
    assert got == sorted((q.qid, t.tid) for q in quotes.collect() for t in rows if q.quote in t.text)


def test_prompts_gather_no_table_of_repositories(spark):
    """No side with a row per repository is broadcast, however small its files look."""
    from flagtide.plans.discovery import prompt_table

    occ = "occurrences array<struct<file_path:string,line:int,kind:string,snippet:string>>"
    cands = spark.createDataFrame([("1", "A_B", [("a.py", 1, "if_statement", "s")], ["a.py"])], f"repo_id string, flag_name string, {occ}, files array<string>")
    ctx = spark.createDataFrame([("1", "text"), ("2", "other")], "repo_id string, text string")
    allow = spark.createDataFrame([("1", "a.py")], "repo_id string, path string")
    again = spark.createDataFrame([("1", 1, "why")], "repo_id string, attempt int, error string")
    df = prompt_table(cands, ctx, allowlist=allow, rejections=again)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.attempt, r.prompt is not None) for r in df.orderBy("attempt").collect()] == [(1, True), (2, True)]
