"""Bodies of chat-completion requests and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.config import EngineConfig

ANSWER = "id string, object string, created bigint, choices array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>"


def request_body(model: Column, prompt: Column, config: EngineConfig) -> Column:
    """The JSON body of a one-message request; zero values are left out, as the wire format has it."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    parts = [model.alias("model"), F.array(message).alias("messages")]
    given = [("max_tokens", config.max_tokens, "int"), ("temperature", config.temperature, "float"), ("top_p", config.top_p, "float")]
    if config.backend == "vllm":
        parts.append(F.lit(True).alias("skip_special_tokens"))
        given.append(("top_k", config.top_k, "int"))
        if config.seed != -1:
            given.append(("seed", config.seed, "int"))
    parts += [F.lit(v).cast(kind).alias(name) for name, v, kind in given if v]
    return F.to_json(F.struct(*parts))


def answer_text(body: Column) -> Column:
    """The first choice's content; null if the body holds none."""
    return F.get(F.from_json(body, ANSWER)["choices"], F.lit(0))["message"]["content"]


def endpoint_of(position: Column, endpoints: tuple[str, ...]) -> Column:
    """Endpoints in turn, by a 0-based position."""
    return F.get(F.array(*[F.lit(e) for e in endpoints]), F.pmod(position, F.lit(len(endpoints))).cast("int"))
