import json
import re

from portcullis.operators import samples as X


def test_answers(spark):
    texts = [
        'Here: {"quality_score": 81, "recommendations": ["a", "b"], "code_smells": ["c"]} end',
        "Quality Score: 72.5\nRecommendations:\n- first thing\n  - second\n\nBye",
        "nothing at all",
        "{broken",
        '{"recommendations": []}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [(r.quality_score, list(r.recommendations)) for r in X.parse_model_response(df).orderBy("id").collect()]
    assert got == [(81.0, ["a", "b"]), (72.5, ["first thing", "second"]), (50.0, []), (50.0, []), (50.0, [])]


def test_failing_model(spark):
    df = spark.createDataFrame([("p", "g", "x"), ("p", "h", "y")], "project_id string, gate string, prompt string")

    def broken(prompts):
        raise RuntimeError("no answer")

    assert [r.answer for r in X.score_with(df, broken).collect()] == [None, None]
    assert sorted(r.answer for r in X.score_with(df, lambda ps: [p.upper() for p in ps]).collect()) == ["X", "Y"]


def test_one_broken_prompt_spoils_no_other(spark):
    def picky(prompts):
        if "y" in prompts:
            raise RuntimeError("no answer")
        return [f'{{"quality_score": {len(p)}}}' for p in prompts]

    df = spark.createDataFrame([("p", g, g) for g in "wxyz"], "project_id string, gate string, prompt string").coalesce(1)
    parsed = X.parse_model_response(X.score_with(df, picky), "answer").collect()
    assert {r.gate: r.quality_score for r in parsed} == {"w": 1.0, "x": 1.0, "y": None, "z": 1.0}
    assert [r.recommendations for r in parsed if r.gate == "y"] == [None]


def test_prompts(spark):
    from checks import queries as Q

    rows = X.gate_prompts(X.prompt_context(Q.full(spark, "/root/testdata/sf0.001"), Q.results(spark, "/root/testdata/sf0.001"))).collect()
    assert len(rows) == 120
    for r in rows:
        context = json.loads(r.context)
        shown = context.get("sample_matches", [])
        assert len(shown) == min(10, context["found_count"])
        assert sum(context.get("severity_distribution", {}).values()) == context["found_count"]
        assert sum(context.get("pattern_types", {}).values()) == context["found_count"]
        assert re.search(rf"^Gate: {r.gate}\nCoverage: {context['found_count']}/{context['expected_count']} ", r.prompt)
        assert "quality_score" in r.prompt
