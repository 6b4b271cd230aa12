"""Prompts, what becomes of a model's answers, and metering."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import CUT_MARK, NO_DOCUMENTS, NO_EVIDENCE, WHITE_SPACE, cost, cut, or_label, or_message, stripped, without_fence
from paperloom.operators.completion import timed

#: The texts of prompts.
GUARDRAIL = (
    "당신은 사내 문서 기반 RAG 어시스턴트입니다. "
    "반드시 제공된 컨텍스트(검색 결과)에 근거해 한국어로 답변하라. "
    "컨텍스트에 없는 내용은 추측하지 말고 '제공된 문서 근거로는 확인할 수 없습니다'라고 답하라. "
    "답변 끝에 핵심 근거(문서명/페이지)를 2~5개 bullet로 제공하라. "
    "문서에 'relationship_note'나 'policy_note' 메타데이터가 있으면 답변에 반영하라."
)
ANALYZE_PROMPT = """당신은 문서 온톨로지 구축을 돕는 전문 AI 어시스턴트입니다.
반드시 아래 JSON 형식으로만 응답하세요:
{
  "category": "문서 카테고리 (정책/재무/기술/법률/인사/연구 등)",
  "tags": ["태그1", "태그2", "태그3"],
  "summary": "문서 내용 2-3줄 요약",
  "consulting": "이 문서를 온톨로지에 통합할 때 고려할 점과 추천사항"
}"""
COLLECTION_PROMPT = """당신은 문서 컬렉션 온톨로지 구축을 돕는 전문 AI 어시스턴트입니다.
반드시 아래 JSON 형식으로만 응답하세요:
{
  "description": "컬렉션 설명 (2-3줄)",
  "category": "컬렉션 카테고리",
  "tags": "태그1, 태그2, 태그3",
  "consulting": "이 컬렉션을 온톨로지에 통합할 때 고려할 점"
}"""
CONTEXT_HEAD, QUESTION_HEAD = "다음은 검색된 문서 컨텍스트입니다:\n\n", "\n\n질문: "
NUMBERED_SOURCE, FILTER_HEAD = "[문서 ", "\n필터 조건: "
FILE_HEAD, CONTENT_HEAD, TOOL_HEAD = "파일명: ", "\n\n내용:\n", "다음 문서를 분석하세요:\n\n"
STATUS_HEAD, STATUS_END = " (상태: ", ")"
COLLECTION_HEADS = ("컬렉션 이름: ", "\n현재 설명: ", "\n현재 카테고리: ", "\n현재 태그: ", "\n문서 수: ", "\n\n포함된 문서 목록:\n")
SOURCES_HEAD, SOURCE_SCORE = "\n\n📌 참고 문서:\n", "] 유사도: "
TOOL_DEFAULTS = {"category": "", "tags": [], "summary": "", "consulting": ""}
TOOL_FAILED = "분석 실패: "
NOT_READY = "인덱싱된 문서가 없습니다. 먼저 문서를 업로드하고 인제스트를 기다려 주세요."
CONTEXT_BREAK = "\n\n---\n\n"
DOCUMENT_FIELDS = (("category", ""), ("tags", "[]"), ("summary", ""), ("consulting", ""))
COLLECTION_FIELDS = (("description", ""), ("category", ""), ("tags", ""), ("consulting", ""))


class Generator(Protocol):
    """A model: one answer for each (system, user) pair."""

    def __call__(self, prompts: list[tuple[str, str]]) -> list[str]: ...


def first_sentence(prompts: list[tuple[str, str]]) -> list[str]:
    """A stand-in without a model: the first sentence of the first context block."""
    out = []
    for _, user in prompts:
        body = user.partition("\n\n")[2].partition("\n")[2]
        out.append(body.split(CONTEXT_BREAK)[0].partition(". ")[0].strip())
    return out


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, context, n_hits: hits (query_id, rank, source, page, text) as one text, in the order of rank."""
    name = F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("["), "source", F.lit("]"))).otherwise(F.concat(F.lit(NUMBERED_SOURCE), F.col("rank").cast("string"), F.lit("]")))
    page = F.when(F.coalesce("page", F.lit("")) != "", F.concat(F.lit(" p."), "page")).otherwise("")
    block = F.concat(name, page, F.lit("\n"), F.coalesce("text", F.lit("")))
    return hits.select("query_id", "rank", block.alias("block")).groupBy("query_id").agg(F.expr(f"listagg(block, '{CONTEXT_BREAK.encode('unicode_escape').decode()}') WITHIN GROUP (ORDER BY rank)").alias("context"), F.count("*").alias("n_hits"))


def filter_note(filters: Column) -> Column:
    """filters: array of (key, value), in order. Blank values are not told of."""
    told = F.filter(filters, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    return F.when(F.size(told) > 0, F.concat(F.lit(FILTER_HEAD), F.array_join(F.transform(told, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ", "))).otherwise("")


def chat_prompts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """queries (query_id, question, note) with context: system, user and n_hits (0 where nothing was found)."""
    rows = queries.join(found, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    user = F.concat(F.lit(CONTEXT_HEAD), F.coalesce("context", F.lit("")), F.lit(QUESTION_HEAD), "question")
    return rows.select("query_id", "n_hits", F.concat(F.lit(GUARDRAIL), F.coalesce("note", F.lit(""))).alias("system"), user.alias("user"))


class Client:
    """A Generator over ask(system, user): at most pool calls in flight, and for each a time limit, from its own start, and attempts. A call
    that has failed so often gives `failed`; a call that hangs holds up no other."""

    def __init__(self, ask: Callable[[str, str], str], pool: int = 8, seconds: float = 30.0, attempts: int = 2, failed: str = ""):
        self.ask, self.pool, self.seconds, self.attempts, self.failed = ask, pool, seconds, attempts, failed

    def one(self, prompt: tuple[str, str]) -> str:
        for _ in range(self.attempts):
            try:
                return timed(self.ask, prompt, self.seconds)
            except Exception:  # noqa: BLE001  whatever a provider raises, and the time limit
                continue
        return self.failed

    def __call__(self, prompts: list[tuple[str, str]]) -> list[str]:
        with ThreadPoolExecutor(self.pool) as calls:
            return list(calls.map(self.one, prompts))


def answered(prompts: DataFrame, generator: Generator) -> DataFrame:
    """prompts with answer. What was not found is not asked for: it gets the fixed message, as an empty answer does; nor is what
    is not ready, if there is such a column: it is told so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            asked = (rows["n_hits"] > 0).to_numpy()
            if "ready" in rows:
                asked &= rows["ready"].fillna(True).to_numpy(bool)
            answers = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            if asked.any():
                answers[asked] = generator(list(zip(rows["system"][asked], rows["user"][asked], strict=True)))
            yield rows.assign(answer=answers)

    made = prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType())]))
    answer = or_message(F.col("answer"))
    return made.withColumn("answer", F.when(~F.col("ready"), F.lit(NOT_READY)).otherwise(answer) if "ready" in prompts.columns else answer)


def no_hit_answer(n_hits: Column, answer: Column) -> Column:
    return F.when(n_hits == 0, F.lit(NO_EVIDENCE)).otherwise(answer)


def analyze_prompt(filename: Column, text: Column) -> Column:
    return F.concat(F.lit(FILE_HEAD), filename, F.lit(CONTENT_HEAD), cut(text, 8000, CUT_MARK))


def tool_analyze_prompt(text: Column) -> Column:
    return F.concat(F.lit(TOOL_HEAD), cut(text, 4000))


def document_lists(documents: DataFrame, most_lines: int | None = None) -> DataFrame:
    """id (of a collection), lines (its documents, a line each, by id) and n. most_lines: of them the first so many, for a prompt that is
    bounded; n counts all. The others are left out before rows move, so that a large collection is no large group."""
    line = F.concat(F.lit("- "), "name", F.lit(STATUS_HEAD), "status", F.lit(STATUS_END))
    rows, order = documents.select("collection_id", "id", line.alias("line")), F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY id)").alias("lines")
    if most_lines is None:
        return rows.groupBy(F.col("collection_id").alias("id")).agg(order, F.count("*").alias("n"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("collection_id").orderBy("id", "line"))).where(F.col("k") <= most_lines)
    listed = first.groupBy(F.col("collection_id").alias("id")).agg(order)
    return rows.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n")).join(listed, "id", "left").select("id", "lines", "n")


def collection_prompts(collections: DataFrame, documents: DataFrame, most_lines: int | None = None) -> DataFrame:
    """id, prompt: a collection's fields and its documents, by id, or the first most_lines of them."""
    rows = collections.join(document_lists(documents, most_lines), "id", "left")
    fields = F.col("name"), or_label(F.col("description")), or_label(F.col("category")), or_label(F.col("tags")), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("lines", F.lit(NO_DOCUMENTS))
    return rows.select("id", F.concat(*(x for head, own in zip(COLLECTION_HEADS, fields, strict=True) for x in (F.lit(head), own))).alias("prompt"))


def json_fields(answers: DataFrame, fields: tuple = DOCUMENT_FIELDS, answer: str = "answer", strict: bool = True) -> DataFrame:
    """answers with the fields of the JSON object in answer, a ``` fence taken off. A field that is absent has its default, one that
    is null stays null; an answer that is no JSON becomes the field consulting. What is JSON but no object is an error if strict,
    else has the defaults."""
    text = stripped(F.col(answer))
    tree = F.try_parse_json(without_fence(text))
    kind = F.schema_of_variant(tree)
    broken = tree.isNull() & text.isNotNull()
    is_object = F.startswith(kind, F.lit("OBJECT"))
    rows = answers.withColumn("_tree", tree).withColumn("_broken", broken).withColumn("_object", F.coalesce(is_object, F.lit(False)))
    if strict:
        rows = rows.withColumn("_object", F.when(~F.col("_broken") & ~F.col("_object") & F.col(answer).isNotNull(), F.raise_error(F.lit("the answer is JSON but no object")).cast("boolean")).otherwise(F.col("_object")))

    def value(name: str, default: str) -> Column:
        own = F.try_variant_get("_tree", f"$.{name}", "variant")
        as_text = F.coalesce(F.try_variant_get("_tree", f"$.{name}", "string"), F.to_json(own))
        found = F.when(F.is_variant_null(own), F.lit(None).cast("string")).when(own.isNotNull(), as_text).otherwise(default)
        failed = text if name == "consulting" else F.lit(default)
        return F.when(F.col("_broken"), failed).when(F.col("_object"), found).otherwise(default).alias(name)

    keep = [c for c in answers.columns if c not in {n for n, _ in fields}]
    return rows.select(*keep, *[value(n, d) for n, d in fields])


def _asked(rows: DataFrame, system: str, user: Column, generator: Generator, fields: tuple) -> DataFrame:
    """rows with the fields of what a model answers; an answer that is no JSON object has the defaults."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    made = rows.select(own, answer_of(generator)(F.lit(system), user).alias("answer"))
    return json_fields(made, fields, strict=False)


def answer_of(generator: Generator) -> Callable[[Column, Column], Column]:
    def run(system: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series(generator(list(zip(system, user, strict=True))), index=user.index, dtype=object)

    return F.pandas_udf(run, "string")


def analyzed(documents: DataFrame, generator: Generator, filename: str = "name", text: str = "text") -> DataFrame:
    """row (all columns of documents), answer, and category, tags, summary, consulting as a model says."""
    return _asked(documents, ANALYZE_PROMPT, analyze_prompt(F.col(filename), F.col(text)), generator, DOCUMENT_FIELDS)


def analyzed_collections(collections: DataFrame, documents: DataFrame, generator: Generator) -> DataFrame:
    """row (id, prompt), answer, and description, category, tags, consulting as a model says."""
    return _asked(collection_prompts(collections, documents), COLLECTION_PROMPT, F.col("prompt"), generator, COLLECTION_FIELDS)


def analyzed_by_tool(rows: DataFrame, ask: Callable[[str, str], str], text: str = "text", pool: int = 8, seconds: float = 30.0) -> DataFrame:
    """row (all columns of rows) and answer: what ask(system, user) says of the first 4000 characters of each text, stripped. A call that
    fails or takes longer gives the JSON of defaults, with the reason in its last field; the others go on."""

    def one(prompt: tuple[str, str]) -> str:
        try:
            return timed(ask, prompt, seconds).strip(WHITE_SPACE)
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            return json.dumps(TOOL_DEFAULTS | {"consulting": f"{TOOL_FAILED}{e}"}, ensure_ascii=False)

    def run(users: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(pool) as calls:
            for some in users:
                yield pd.Series(list(calls.map(one, [(ANALYZE_PROMPT, u) for u in some])), index=some.index, dtype=object)

    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    return rows.select(own, F.pandas_udf(run, "string")(tool_analyze_prompt(F.coalesce(text, F.lit("")))).alias("answer"))


def provider_messages(messages: DataFrame) -> DataFrame:
    """conv_id, system (the last system message, or empty) and messages (the others, in order) for providers that want them apart."""
    system = F.expr("coalesce(max_by(text, turn) FILTER (WHERE role = 'system'), '')")
    others = F.expr("transform(array_sort(collect_list(struct(turn, role, text)) FILTER (WHERE role <> 'system')), m -> struct(m.role AS role, m.text AS content))")
    return messages.groupBy("conv_id").agg(system.alias("system"), others.alias("messages"))


def normalised_usage(prompt: Column, completion: Column, input_: Column, output: Column, total: Column, separate: Column) -> tuple[Column, Column, Column]:
    """Token counts by the provider's own names: where they are separate the total is their sum, null counting 0."""
    own_total = F.coalesce(input_, F.lit(0)) + F.coalesce(output, F.lit(0))
    return F.when(separate, input_).otherwise(prompt), F.when(separate, output).otherwise(completion), F.when(separate, own_total).otherwise(total)


def usage_events(requests: DataFrame, model: str, per_million_in: float, per_million_out: float, endpoint: str = "/chat") -> DataFrame:
    """A row for each request (id, collection_id, ready, cached, prompt_tokens, completion_tokens, total_tokens, latency_ms) that passed the gate and was not answered from the cache; model is the first provider's, whoever answered."""
    logged = requests.where(F.col("ready") & ~F.col("cached"))
    return logged.select("id", F.lit(endpoint).alias("endpoint"), F.lit(model).alias("model"), "collection_id", "prompt_tokens", "completion_tokens", "total_tokens", cost(F.col("prompt_tokens"), F.col("completion_tokens"), per_million_in, per_million_out).alias("cost_usd"), "latency_ms", F.lit(False).alias("cached"))


def sources_footer(answers: DataFrame, cited: DataFrame, most: int = 5) -> DataFrame:
    """query_id, answer with its first citations (query_id, rank, text, score) below."""
    line = F.concat(F.lit("  - ["), "text", F.lit(SOURCE_SCORE), F.col("score").cast("string"))
    foot = cited.where(F.col("rank") <= most).select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY rank)").alias("foot"))
    return answers.join(foot, "query_id", "left").select("query_id", F.when(F.col("foot").isNotNull(), F.concat("answer", F.lit(SOURCES_HEAD), "foot")).otherwise(F.col("answer")).alias("answer"))
