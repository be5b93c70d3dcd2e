import random

import pytest
from pyspark.sql import functions as F

from lexmere.functions.fixed import DEFAULT_EXPANSIONS
from lexmere.operators import context, evaluate, expansion, rerank
from lexmere.operators.expansion import dictionary_table, expand_questions
from lexmere.operators.index import build_index
from lexmere.plans.ask import fill_answers, make_prompts, retrieve, run_report
from lexmere.plans.evaluation import evaluate as evaluate_plan
from lexmere.sources.writers import complete
from tests import brute

RESULT = (
    "qid string, rank int, score double, chunk_id string, text string, topic array<string>, "
    "title string, page int"
)


def results(spark, n, text="line one\nline two "):
    rows = [
        ("q", r, 10.0 / r, f"Doc A::p{r}::c0", text + "z" * 2000, ["econ"], "Title", r)
        for r in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, RESULT)


def test_expansion_equals_a_plain_scan(spark):
    def plain(q):
        seen, extra = set(), []
        for key, values in DEFAULT_EXPANSIONS.items():
            if q.lower().find(key) >= 0:
                for v in values:
                    if v.lower() not in seen:
                        seen.add(v.lower())
                        extra.append(v)
        return " ".join([q, *extra])

    asked = [
        "strict exogeneityとは？", "PPOのclip objectiveを説明して", "weekly instrumental notes",
        "GMM two-step M-estimators HAC and endogeneity, Hausman", "nothing here", "kl",
    ]
    df = spark.createDataFrame([(i, q, None) for i, q in enumerate(asked)], "qid int, question string, topic string")
    got = expand_questions(df, dictionary_table(spark, DEFAULT_EXPANSIONS)).collect()
    assert {r["qid"]: r["expanded"] for r in got} == {i: plain(q) for i, q in enumerate(asked)}
    assert plain(asked[0]).endswith("strictly exogenous FE.1 FD.1 leads test")


def test_context_layout(spark):
    assert context.support_cap(1400) == 489 and context.support_cap(100) == 100
    text = context.contexts(results(spark, 5)).first()["context"]
    blocks = text.split("\n\n---\n\n")
    assert blocks[0] == "## Evidence (high priority)" and blocks[4] == "## Support (lower priority)"
    assert len(blocks) == 7
    head, body = blocks[2].split("\n")
    assert head == "[#2 | w=0.50 | score=5.0000 | Doc A::p2::c0 | p2 | Title | topic=['econ']]"
    assert body.startswith("line one line two zz") and len(body) == 1400
    assert len(blocks[5].split("\n")[1]) == 489


def test_few_results_and_no_headings(spark):
    three = context.contexts(results(spark, 3)).first()["context"]
    assert "## Support" not in three
    bare = context.contexts(results(spark, 5), evidence_k=0).first()["context"]
    assert "##" not in bare and len(bare.split("\n\n---\n\n")) == 5


def test_missing_fields_print_defaults(spark):
    row = results(spark, 1).withColumn("page", F.lit(None).cast("int")).withColumn(
        "title", F.lit(None).cast("string")
    ).withColumn("topic", F.lit(None).cast("array<string>"))
    head = context.context_blocks(row).first()["block"].split("\n")[0]
    assert head == "[#1 | w=1.00 | score=10.0000 | Doc A::p1::c0 | p? |  | topic=[]]"


def test_weights(spark):
    rows = results(spark, 3)
    soft = context.weights(rows, "softmax", 0.0).orderBy("rank").collect()
    assert sum(r["w"] for r in soft) == pytest.approx(1)
    zero = context.weights(rows.withColumn("score", F.lit(0.0))).collect()
    assert {r["w"] for r in zero} == {0.0}


def test_prompt_modes(spark):
    asked = spark.createDataFrame([("q", " why? ", None), ("r", "x", None)], "qid string, question string, topic string")
    for mode in ("explore", "CITE_STRICT", None, "strict", "english"):
        got = {r["qid"]: r["prompt"] for r in context.prompts(
            asked, context.contexts(results(spark, 2)), mode).collect()}
        assert "why?" in got["q"] and " why? " not in got["q"] and got["q"].endswith("\n")
        assert "{" not in got["q"] and "[#2 |" in got["q"] and "[#1" not in got["r"]
    with pytest.raises(ValueError):
        context.prompt_text("question", F.lit(""), "other")


def test_outline_and_draft(spark):
    answer = context.outline_answers(results(spark, 10)).first()["answer"].split("\n")
    assert len(answer) == 8 and answer[2] == "Relevant evidence line 3 (Doc A::p3::c0, p3)"
    asked = spark.createDataFrame([("q", "why?", None)], "qid string, question string, topic string")
    draft = context.drafts(asked, results(spark, 10)).first()["draft"]
    bullets = [x for x in draft.split("\n") if x.startswith("- line one")]
    assert len(bullets) == 6 and bullets[0].endswith("z (Doc A::p1::c0, p1)")
    assert len(bullets[0]) == len("- ") + 260 + len(" (Doc A::p1::c0, p1)")


def test_mmr_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["the"]
    rows, asked, want = [], [], {}
    for q in range(12):
        query = " ".join(rng.choice(words) for _ in range(6))
        texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        if len(texts) > 3:
            texts[2] = texts[1]
        asked.append((str(q), query, None))
        rows += [(str(q), i + 1, 9.0 - i, f"c{i:02d}", t, ["t"], "T", 1) for i, t in enumerate(texts)]
        want[str(q)] = brute.mmr(query, texts, 5, 0.7)
    pool = spark.createDataFrame(rows, RESULT)
    questions = spark.createDataFrame(asked, "qid string, question string, topic string")
    got = {}
    for r in rerank.mmr()(pool, questions, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(int(r["chunk_id"][1:]))
    assert got == want
    with pytest.raises(ValueError):
        rerank.by_name("other")


def eval_rows(spark, rows):
    return spark.createDataFrame(
        rows, "qid string, question string, topic string, gold_chunk_ids array<string>, answer string"
    )


def test_undefined_metrics_are_nan(spark):
    rows = eval_rows(spark, [("a", "q", None, None, None), ("b", "q", None, [], "")])
    found = spark.createDataFrame([("a", "x")], "qid string, chunk_id string")
    got = evaluate.metrics(rows, found).first().asDict()
    assert (got["n_total"], got["n_with_gold"], got["n_with_answer"]) == (2, 0, 0)
    assert all(got[k] != got[k] for k in got if not k.startswith("n_"))


def test_citation_counts(spark):
    answer = (
        "First (Doc A::p1::c0, p1). Second has none. Third (no,pe) (Doc A::p9::c0 , p9) "
        "(Doc A::p9::c0, p9)!\nＦｕｌｌ（Doc A::p1::c0, p1） line (Doc\nB::p1::c0, p3)"
    )
    rows = eval_rows(spark, [("a", "q", None, ["z", "Doc A::p1::c0"], answer), ("b", "q", None, ["z"], None)])
    found = spark.createDataFrame([("a", "Doc A::p1::c0"), ("b", "y")], "qid string, chunk_id string")
    assert evaluate.recall(rows, found).first().asDict() == {"n_with_gold": 2, "recall_at_k": 0.5}
    got = evaluate.faithfulness(rows, found).first().asDict()
    import re

    pattern = re.compile(r"\(([^,]+?)\s*,\s*p(\d+)\)")
    sentences = re.split(r"(?<=[。．.!?])\s+", answer)
    cites = [pattern.findall(s) for s in sentences]
    assert got["units"] == len(sentences) == 4
    assert got["cited"] == sum(bool(c) for c in cites)
    assert got["cites"] == sum(map(len, cites))
    assert got["bad"] == sum(c[0].strip() != "Doc A::p1::c0" for cs in cites for c in cs)
    line = evaluate.faithfulness(rows, found, "line").first()
    assert line["units"] == 3


def test_plans_end_to_end(spark):
    texts = {
        f"Doc::p{i}::c0": f"strict exogeneity holds for panel{i % 3} and policy gradient{i % 4}" for i in range(24)
    }
    chunks = spark.createDataFrame(
        [(k, t, ["econ"], "T", i) for i, (k, t) in enumerate(texts.items())],
        "chunk_id string, text string, topic array<string>, title string, page int",
    )
    index = build_index(chunks)
    asked = eval_rows(spark, [
        ("q1", "panel2 with gradient3", "econ", ["Doc::p11::c0"], None),
        ("q2", "unknown words only zzz", "econ", ["Doc::p1::c0"], None),
    ])
    made = {r["qid"]: r for r in make_prompts(index, asked, rerank="mmr", mode="explore").collect()}
    assert made["q1"]["prompt_meta"]["rerank"] == "mmr" and "[#8 |" in made["q1"]["prompt"]
    assert made["q1"]["gold_chunk_ids"] == ["Doc::p11::c0"]
    filled = fill_answers(index, asked)
    got = {r["qid"]: r["answer"] for r in filled.collect()}
    assert got["q2"] == "" and len(got["q1"].split("\n")) == 8
    metrics = evaluate_plan(index, filled, unit="line").first()
    assert metrics["n_with_answer"] == 1 and metrics["citation_sentence_rate"] == 1.0
    assert metrics["bad_citation_rate"] == 0.0 and metrics["recall_at_k"] == 0.5
    report = {r["qid"]: r for r in run_report(index, asked, outline=True).collect()}
    assert report["q1"]["evidence"].count("\n") == 7 and report["q2"]["evidence"] is None
    assert retrieve(index, asked, top_k=3).count() == 3
    with pytest.raises(ValueError):
        make_prompts(index, asked, mode="strict")
    answers = complete(make_prompts(index, asked), lambda p: str(len(p)), ["qid"]).collect()
    assert all(int(r["response"]) > 100 for r in answers)


def test_older_modes_and_outline(spark):
    asked = spark.createDataFrame([("q", "why?", None), ("r", "none", None)], "qid string, question string, topic string")
    lines = {r["qid"]: r["answer"].split("\n") for r in context.older_outlines(asked, results(spark, 8)).collect()}
    assert len(lines["q"]) == 2 + 6 + 2 and lines["q"][0] == "Answer (citation-per-sentence):"
    assert lines["q"][2].startswith("Evidence #1: This chunk is relevant to the question. (") and lines["r"][1:3] == ["", ""]
    texts = {f"d{i}::p1::c0": f"alpha beta words{i % 2}" for i in range(6)}
    rows = spark.createDataFrame([(k, t, ["x"], "T", 1) for k, t in texts.items()], "chunk_id string, text string, topic array<string>, title string, page int")
    shown = run_report(build_index(rows), spark.createDataFrame([("q", "words1", None)], "qid string, question string, topic string"), mode="strict").first()
    assert "score=" in shown["prompt"] and "w=" not in shown["prompt"]
    with pytest.raises(ValueError, match="unknown mode"):
        run_report(build_index(rows), asked, mode="other")


def test_keys_far_from_every_question_are_dropped_first(spark, monkeypatch):
    words = {f"zz{i} qq{i}": [f"v{i}"] for i in range(500)} | {f"panel d{i} data and kl": [f"w{i}"] for i in range(50)} | {"kl": ["KL"], "": ["none"], "panel data": ["PD"], "data panel": ["DP"]}
    seen = []
    whole = expansion._rare_grams
    monkeypatch.setattr(expansion, "_rare_grams", lambda keys: seen.append(keys.count()) or whole(keys))
    asked = spark.createDataFrame([(0, "Panel data and KL"), (1, "nothing"), (2, None), (3, "")], "qid long, question string")
    got = {r.qid: r.expanded for r in expand_questions(asked, dictionary_table(spark, words)).collect()}
    assert got == {0: "Panel data and KL KL none PD", 1: "nothing none", 2: "", 3: " none"}
    assert seen[0] <= 4
