"""Detection by a language model that the caller injects: prompts, calls by partition, and reading the answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from threading import Condition, Thread
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import give_back, slices
from ..functions.entity import entity, no_entities, problems

CONFIDENCE = 0.85
ANSWER = T.StructType(
    [
        T.StructField(
            "entities",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("type", T.StringType()),
                        T.StructField("value", T.StringType()),
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("confidence", T.DoubleType()),
                    ]
                )
            ),
        )
    ]
)


class Engine(Protocol):
    """A model as a task uses it; it is opened once in each task."""

    def generate(self, prompt: str, system_prompt: str | None = None, temperature: float = 0.0, max_tokens: int = 512) -> str: ...


def _parts(template: str) -> list[str]:
    """What stands between the texts of a template's prompts."""
    return [x.replace("{{", "{").replace("}}", "}") for x in template.split("{text}")]


def rendered(template: str, text: Column) -> Column:
    """A prompt from a template with {text}; doubled braces stand for single ones."""
    parts = _parts(template)
    out = F.lit(parts[0])
    for part in parts[1:]:
        out = F.concat(out, text, F.lit(part))
    return out


class Calls:
    """Calls to a model in a task: at most ``width`` at once, each with an engine of its own in a daemon thread of its own.

    A call that fails gives None, as does one that takes longer than ``timeout`` seconds; such a call is left behind with its engine, and a new one serves the rest.
    """

    def __init__(self, open_engine: Callable[[], Engine], width: int = 1, system: str | None = None, timeout: float | None = None):
        self._open, self._width, self._system, self._timeout = open_engine, width, system, timeout
        self._idle: list[Engine] = []
        self._flying: list[_Call] = []
        self._ended = Condition()

    def submit(self, prompt: str | None) -> _Call:
        """Begin a call, once there is room for it; a null prompt is not asked."""
        if prompt is None:
            return _Call(None, None, ended=True)
        self._room_for(self._width)
        call = _Call(self._idle.pop() if self._idle else self._open(), time.monotonic())
        if self._width == 1 and self._timeout is None:
            self._run(call, prompt)
            return call
        self._flying.append(call)
        Thread(target=self._run, args=(call, prompt), daemon=True).start()
        return call

    def answer(self, call: _Call) -> str | None:
        """A call's answer, waited for."""
        while not call.ended:
            self._land(call)
        return call.answer

    def _run(self, call: _Call, prompt: str) -> None:
        try:
            answer = call.engine.generate(prompt, self._system)
        except Exception:  # a failed call is a missing answer
            answer = None
        with self._ended:
            if not call.ended:  # else it was given up
                call.answer, call.ended = answer, True
                self._idle.append(call.engine)
            self._ended.notify_all()

    def _room_for(self, width: int) -> None:
        while len(self._flying) >= width:
            self._land()

    def _land(self, wanted: _Call | None = None) -> None:
        """Wait until some call ends, or until the first one is overdue."""
        with self._ended:
            landed = [c for c in self._flying if c.ended]
            if not landed and not (wanted and wanted.ended):
                first = min(c.began for c in self._flying)
                self._ended.wait(None if self._timeout is None else max(0.0, first + self._timeout - time.monotonic()))
            for c in self._flying:
                if not c.ended and self._timeout is not None and time.monotonic() - c.began >= self._timeout:
                    c.ended = True
            self._flying = [c for c in self._flying if not c.ended]


@dataclass(eq=False)
class _Call:
    engine: Engine | None
    began: float | None
    answer: str | None = None
    ended: bool = False


def ask(
    rows: DataFrame, open_engine: Callable[[], Engine], prompt: str = "prompt", system: str | None = None, timeout: float | None = None, into: str = "response", width: int = 1, read: Callable[[str | None], str | None] | None = None, template: str | None = None
) -> DataFrame:
    """Add each prompt's answer, or what ``read`` makes of it; a failed call, or one beyond ``timeout`` seconds, gives null and the job goes on.

    Up to ``width`` calls of a task are in flight at once, also from one run of rows to the next; rows keep their order. Prompts and answers become Python values
    in runs of about a megabyte, of which a task holds two at most. With a ``template`` (see ``rendered``) the column holds texts, blank ones are not asked, and a
    prompt is made where it is asked, so that a text does not travel twice.
    """
    kept = [f for f in rows.schema.fields if f.name != into]
    run = _asking(lambda: Calls(open_engine, width, system, timeout), prompt, into, read, template)
    return rows.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))


def _asking(open_calls: Callable[[], Calls], prompt: str, into: str, read: Callable[[str | None], str | None] | None = None, template: str | None = None) -> Callable:
    parts = ["", ""] if template is None else _parts(template)
    size = {"times": max(1, len(parts) - 1), "beside": sum(len(x.encode()) for x in parts)}

    def filled(text: str | None) -> str | None:
        return text.join(parts) if text and text.strip(" ") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls, before = open_calls(), None

        def finished(own: pa.RecordBatch, asked: list[_Call]) -> pa.RecordBatch:
            answers = map(calls.answer, asked)
            return own.append_column(into, pa.array(map(read, answers) if read else answers, pa.string()))

        for batch in batches:
            for own in slices(batch, prompt, **size):
                asked = own.column(prompt).to_pylist()
                now = own, [calls.submit(x) for x in (asked if template is None else map(filled, asked))]
                if before:
                    yield finished(*before)
                before = now
        if before:
            yield finished(*before)
        before = now = own = batch = None
        give_back()

    return run


def ask_once(rows: DataFrame, open_engine: Callable[[], Engine], prompt: str = "prompt", system: str | None = None, timeout: float | None = None, into: str = "response", width: int = 1, tasks: int | None = None, read: Callable[[str | None], str | None] | None = None) -> DataFrame:
    """``ask``, with every distinct prompt asked once and its answer joined back to all rows that have it; ``tasks`` deals the distinct prompts anew.

    Rows whose prompt is null have a null answer. The order of rows is not kept.
    """
    keyed = rows.drop(into).withColumn("__asked", F.sha2(F.col(prompt).cast("binary"), 256))
    distinct = keyed.where(F.col(prompt).isNotNull()).groupBy("__asked").agg(F.first(prompt).alias("__prompt"))
    distinct = distinct if tasks is None else distinct.repartition(tasks)
    answers = ask(distinct, open_engine, "__prompt", system, timeout, into, width, read).drop("__prompt")
    return keyed.join(answers, "__asked", "left").drop("__asked")


def first_object(response: str | None) -> str | None:
    """The first balanced JSON object of an answer, thoughts taken out; null if there is none that parses."""
    if response is None:
        return None
    import re

    text = re.sub(r"(?is)<think>.*?</think>|</?think>", "", response)
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)) if start >= 0 else ():
        c = text[k]
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                found = text[start : k + 1]
                try:
                    json.loads(found)
                except ValueError:
                    return None
                return found
    return None


@F.pandas_udf(T.StringType())
def extract_json(response: pd.Series) -> pd.Series:
    """``first_object`` of a column; bracket matching is beyond regular expressions."""
    return response.map(first_object)


def lenient_json(response: Column) -> Column:
    """What lies from the first { to the last }, for answers with text around one object."""
    start = F.locate("{", response)
    end = F.length(response) - F.locate("}", F.reverse(response)) + 1
    return F.when((start > 0) & (F.locate("}", response) > 0) & (end >= start), F.substr(response, start, end - start + 1))


def marked_json(response: Column, begin: str = '{"entities"', end: str = "<|im_end|>") -> Column:
    """What lies from the first ``begin`` to the next ``end`` or, without one, to the end of the answer."""
    rest = F.substr(response, F.locate(begin, response), F.length(response))
    return F.when(F.locate(begin, response) > 0, F.trim(F.substring_index(rest, end, 1)))


@F.pandas_udf(T.StringType())
def whole_object(response: pd.Series) -> pd.Series:
    """The answer itself if all of it is one JSON object whose entities, if it has any, are objects; otherwise null."""

    def one(x: str | None) -> str | None:
        try:
            found = json.loads(x).get("entities", [])
            return x if isinstance(found, list) and all(isinstance(e, dict) for e in found) else None
        except (ValueError, TypeError, AttributeError):
            return None

    return response.map(one)


_TUNED = "struct<entities: array<struct<type: string, value: string, start_pos: int, end_pos: int, confidence: double>>>"


def tuned_entities(text: Column, response_json: Column, name: str = "tuned_model", least: float = 0.0) -> Column:
    """Entities of a tuned model's answer (see ``whole_object``): a missing type is UNKNOWN, missing positions are looked up.

    An entity whose value isn't in the text goes. One that is unsound empties the whole list, as an answer that doesn't parse does.
    """

    def one(a: Column) -> Column:
        value = F.coalesce(a["value"], F.lit(""))
        given = a["start_pos"].isNotNull() & a["end_pos"].isNotNull()
        start = F.when(given, a["start_pos"]).otherwise(F.call_function("locate", value, text) - 1)
        end = F.when(given, a["end_pos"]).otherwise(start + F.length(value))
        found = entity(F.coalesce(a["type"], F.lit("UNKNOWN")), value, start, end, F.coalesce(a["confidence"], F.lit(CONFIDENCE)), "llm_finetuned", name)
        return F.when(given | (start >= 0), found)

    found = F.array_compact(F.transform(F.from_json(response_json, _TUNED)["entities"], one))
    sound = F.forall(found, lambda e: F.size(problems(e)) == 0)
    return F.coalesce(F.when(sound, F.filter(found, lambda e: e["confidence"] >= least)), no_entities())


def answered(response_json: Column) -> Column:
    """The entities of an answer in JSON: those with a type and a value."""
    found = F.from_json(response_json, ANSWER)["entities"]
    return F.filter(F.coalesce(found, F.from_json(F.lit("[]"), ANSWER["entities"].dataType)), lambda e: e["type"].isNotNull() & e["value"].isNotNull())


def placed(text: Column, answers: Column, kinds: tuple[str, ...] | None = None, name: str = "model", method: str = "llm", least: float = 0.0) -> Column:
    """Entities of answers: positions inside the text are trusted, others are looked up, and what isn't in the text goes."""

    def one(a: Column) -> Column:
        n = F.length(text)
        known = a["start"].isNotNull() & a["end"].isNotNull() & (a["start"] >= 0) & (a["end"] <= n) & (a["start"] < a["end"])
        start = F.when(known, a["start"]).otherwise(F.call_function("locate", a["value"], text) - 1)
        end = F.when(known, a["end"]).otherwise(start + F.length(a["value"]))
        confidence = F.coalesce(a["confidence"], F.lit(CONFIDENCE))
        fine = (start >= 0) & (F.length(a["value"]) > 0) & (confidence >= least)
        fine = fine & a["type"].isin(*kinds) if kinds else fine
        return F.when(fine, entity(a["type"], a["value"], start, end, confidence, method, name))

    return F.coalesce(F.array_compact(F.transform(answers, one)), no_entities())


def model_detect(rows: DataFrame, open_engine: Callable[[], Engine], template: str, kinds: tuple[str, ...] | None = None, text: str = "text", least: float = 0.0, into: str = "model_entities", once: bool = False, **how) -> DataFrame:
    """Ask for each text's entities and add those of the wanted kinds; blank texts are not sent, a failed call gives none.

    With ``once`` equal texts are sent once. ``how`` goes to ``ask`` or ``ask_once``: timeout, width and so on.
    """
    if once:
        blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
        prompts = rows.withColumn("__prompt", F.when(~blank, rendered(template, F.col(text))))
        asked = ask_once(prompts, open_engine, "__prompt", into="__json", read=first_object, **how)
    else:
        own = any(f.name == text and isinstance(f.dataType, T.StringType) for f in rows.schema.fields)  # else a field of a struct, or no string
        texts = rows if own else rows.withColumn("__prompt", F.col(text).cast("string"))
        asked = ask(texts, open_engine, text if own else "__prompt", into="__json", read=first_object, template=template, **how)
    return asked.withColumn(into, placed(F.col(text), answered(F.col("__json")), kinds, least=least)).drop("__prompt", "__json")


def conversation_text(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, text, turns): a conversation's turns, a line each; ``turns`` has where each begins in the text."""
    lines = turns.select(key, F.col(turn).alias("turn"), F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")), F.lit("\n")).alias("line"))
    at = F.sum(F.length("line")).over(_before(key))
    lines = lines.withColumn("start", F.coalesce(at, F.lit(0)))
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "start", "line"))).alias("t")).select(key, F.array_join("t.line", "").alias("text"), F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"))).alias("turns"))


def _before(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)


def source_turn(start: Column, turns: Column) -> Column:
    """The turn in which a position of a conversation's text lies."""
    return F.array_max(F.transform(F.filter(turns, lambda t: t["start"] <= start), lambda t: t["turn"]))
