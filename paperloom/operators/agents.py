"""Agent pipelines: roles, task texts, and stages whose context is what earlier stages gave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import cut

#: Roles (key, role, goal, tools, most rounds).
ROLES = (
    ("researcher", "문서 리서처", "사용자 질문에 관련된 내부 문서를 검색하고 핵심 정보를 추출한다", ("rag_search_tool", "list_collections_tool"), 5),
    ("analyst", "데이터 분석가", "검색된 문서를 분석하고 정확하고 명확한 한국어 답변을 작성한다", (), None),
    ("fact_checker", "팩트 체커", "분석가의 답변이 실제 문서 근거와 일치하는지 검증한다", ("rag_search_tool",), None),
    ("report_writer", "보고서 작성자", "분석 결과를 구조화된 한국어 보고서로 작성한다", ("document_analyze_tool",), None),
)
#: Modes (asked, given back, stages as (name, role, names of the stages it sees)).
MODES = {
    "single": ("single_agent", (("answer", "assistant", ()),)),
    "rag_crew": ("rag_crew_2agent", (("research", "researcher", ()), ("analysis", "analyst", ("research",)))),
    "research_crew": ("research_crew_3agent", (("research", "researcher", ()), ("fact_check", "fact_checker", ("research",)), ("report", "report_writer", ("research", "fact_check")))),
}
#: Task texts; {query}, {collection} and {text} are filled in.
TASKS = {
    "search": "컬렉션 '{collection}'에서 다음 질문과 관련된 문서를 검색하세요:\n질문: {query}\n\nrag_search_tool(query='{query}', collection_name='{collection}')을 호출하세요.",
    "answer": "다음 질문에 한국어로 답변하세요:\n질문: {query}\n\n반드시 제공된 컨텍스트 문서에 근거하여 답변하세요.\n컨텍스트에 없는 내용은 추측하지 마세요.\n답변 끝에 참고 문서 목록을 포함하세요.",
    "summary": "다음 문서를 분석하고 구조화된 요약을 작성하세요:\n\n{text}\n\n요약 형식:\n- 문서 목적 (1~2문장)\n- 핵심 내용 bullet 3~5개\n- 주요 수치/날짜 (있는 경우)\n- 권장 액션 (있는 경우)",
    "comparison": "다음 주제에 대한 여러 문서를 비교 분석하세요:\n주제: {query}\n컬렉션: {collection}\n\n분석 절차:\n1. 관련 문서 검색\n2. 각 문서의 핵심 주장/데이터 추출\n3. 공통점과 차이점 비교\n4. 종합 결론 도출",
    "fact_check": "다음 주장을 내부 문서를 기반으로 검증하세요:\n주장: {query}\n컬렉션: {collection}\n\n검증 절차:\n1. 관련 문서 검색\n2. 주장을 지지하거나 반박하는 근거 탐색\n3. 판정: 사실 / 거짓 / 불확실 중 하나 선택\n4. 근거 문서 인용",
    "report": "다음 주제에 대한 전문 보고서를 한국어로 작성하세요:\n주제: {query}\n\n보고서 구조:\n1. 요약 (Executive Summary)\n2. 배경 및 목적\n3. 핵심 발견사항\n4. 세부 분석\n5. 결론 및 권고사항\n6. 참고 문서",
}
SUMMARY_CHARS = 3000


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, r, g, list(t), m) for k, r, g, t, m in ROLES], "key string, role string, goal string, tools array<string>, max_iter int")


def given_mode(asked: Column) -> Column:
    """The mode that a result carries; an unknown one is run as the crew of two."""
    out = None
    for name, (given, _) in MODES.items():
        if name != "rag_crew":
            out = F.when(asked == name, given) if out is None else out.when(asked == name, given)
    return out.otherwise(MODES["rag_crew"][0])


def task_text(kind: str, query: Column, collection: Column, text: Column | None = None) -> Column:
    """One task's text; a document in it is cut to 3000 characters."""
    filled = {"query": query, "collection": collection, "text": cut(text, SUMMARY_CHARS) if text is not None else F.lit("")}
    parts: list[Column] = []
    rest = TASKS[kind]
    while rest:
        before, brace, after = rest.partition("{")
        parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(filled[name])
    return F.concat(*parts)


Stage = Callable[[DataFrame], DataFrame]


def run_mode(runs: DataFrame, mode: str, stage: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """run_id, mode, task_no, task, role, output of every stage of a mode for each of runs (run_id, query, collection).

    stage(role, rows) adds `output` to rows with `context`: the outputs of the stages that it sees, in order, joined on run_id."""
    given, stages = MODES.get(mode, MODES["rag_crew"])
    done: dict[str, DataFrame] = {}
    out = None
    for number, (name, role, seen) in enumerate(stages):
        rows = runs.withColumn("context", F.lit("")) if not seen else runs
        for i, earlier in enumerate(seen):
            rows = rows.join(done[earlier].select("run_id", F.col("output").alias(f"_seen{i}")), "run_id", "left")
        if seen:
            rows = rows.withColumn("context", F.array_join(F.array(*[F.coalesce(F.col(f"_seen{i}"), F.lit("")) for i in range(len(seen))]), "\n\n")).drop(*[f"_seen{i}" for i in range(len(seen))])
        made = stage(role, rows.withColumn("task", F.lit(name)))
        done[name] = made
        own = made.select("run_id", F.lit(given).alias("mode"), F.lit(number).alias("task_no"), F.lit(name).alias("task"), F.lit(role).alias("role"), "output")
        out = own if out is None else out.union(own)
    return out
