"""Where translations and execution results come from.

A provider maps rows to rows. Expression providers are deterministic columns
and stay in the plan; the others call out in ``mapInPandas``, once for each
distinct key.
"""

from __future__ import annotations

import contextlib
import json
import os
import signal
import subprocess
import sys
import tempfile
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.config import ConfigError, EngineConfig
from codeloom.functions.chat import answer_text, endpoint_of
from codeloom.functions.code import RUN, TEST
from codeloom.functions.text import file_extension, outcome_text
from codeloom.schemas import EXTENSIONS, INVALID_UTF8

MOST_OUTPUT = 1 << 20
FAILED_CALL = "INFERENCE_ERROR_RETRIED"


class InferenceProvider(Protocol):
    """Adds response, inference_ok and wall_ms. ``keyed``: equal keys have equal answers, so each is asked for once."""

    keyed: bool

    def infer(self, calls: DataFrame) -> DataFrame: ...


class ExecutionProvider(Protocol):
    """Adds output, exit_ok and wall_ms."""

    keyed: bool

    def execute(self, runs: DataFrame) -> DataFrame: ...


@dataclass
class ExpressionInference:
    """Answers that are expressions of a call's columns."""

    response: Column
    ok: Column = field(default_factory=lambda: F.lit(True))
    keyed: bool = False

    def infer(self, calls: DataFrame) -> DataFrame:
        ok = F.coalesce(self.ok, F.lit(False))
        return calls.withColumns({"response": F.when(ok, F.coalesce(self.response, F.lit(""))).otherwise(""), "inference_ok": ok, "wall_ms": F.lit(0).cast("long")})


@dataclass
class TableInference:
    """Answers from a table (model, prompt, response); a call that is not there fails."""

    answers: DataFrame
    keyed: bool = False

    def infer(self, calls: DataFrame) -> DataFrame:
        known = self.answers.dropDuplicates(["model", "prompt"]).select("model", "prompt", "response", F.lit(True).alias("inference_ok"))
        out = calls.join(known, ["model", "prompt"], "left")
        return out.withColumns({"response": F.coalesce("response", F.lit("")), "inference_ok": F.coalesce("inference_ok", F.lit(False)), "wall_ms": F.lit(0).cast("long")})


def spread(rows: DataFrame, workers: int) -> tuple[DataFrame, int]:
    """(``rows`` in tasks, threads of each task) so that at most ``workers`` calls run at a time."""
    tasks = max(1, min(workers, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks), max(1, workers // tasks)


def _side_by_side(do, rows: Iterator, threads: int) -> list:
    """``do`` of each row, in order, in ``threads`` threads."""
    if threads == 1:
        return [do(*r) for r in rows]
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(do, *r) for r in rows]]


#: Answers by which a server says that the same call may succeed later; other refusals are final.
PASSING = (408, 425, 429)


@dataclass
class HttpInference:
    """Chat completions from endpoints in turn; calls have a column body. Failures are rows, not errors.

    Calls that fail are repeated at the next endpoint, unless the server refuses
    the call itself. At most ``workers`` calls run at a time.
    """

    endpoints: tuple[str, ...]
    token: str = ""
    retries: int = 6
    pause: float = 10.0
    timeout: float = 600.0
    workers: int = 2
    keyed: bool = True

    def infer(self, calls: DataFrame) -> DataFrame:
        ask = self._ask
        dealt, threads = spread(calls, self.workers)
        # Rows of one task take endpoints in turn, and tasks begin at different ones.
        position = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt = dealt.withColumn("endpoint", endpoint_of(position, self.endpoints))

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = _side_by_side(ask, zip(f["body"], f["endpoint"], strict=True), threads)
                yield f.assign(answer=[g[0] for g in got], wall_ms=[g[1] for g in got])

        done = dealt.mapInPandas(work, f"{_schema(dealt)}, answer string, wall_ms long")
        text = answer_text(F.col("answer"))
        return done.withColumns({"response": F.coalesce(text, F.lit(FAILED_CALL)), "inference_ok": text.isNotNull()}).select(*calls.columns, "response", "inference_ok", "wall_ms")

    def _ask(self, body: str, endpoint: str) -> tuple[str | None, int]:
        began = time.monotonic()
        first = self.endpoints.index(endpoint)
        for attempt in range(self.retries + 1):
            url = self.endpoints[(first + attempt) % len(self.endpoints)].rstrip("/") + "/chat/completions"
            request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    answer = r.read().decode()
                json.loads(answer)["choices"][0]["message"]["content"].encode()
                return answer, _ms(began)
            except urllib.error.HTTPError as e:
                if 400 <= e.code < 500 and e.code not in PASSING:
                    break
            except (OSError, ValueError, LookupError, TypeError, AttributeError):
                pass
            if attempt < self.retries:
                time.sleep(self.pause)
        return None, _ms(began)


#: A column of a run by its name.
Ask = Callable[[str], Column]


@dataclass
class ExpressionExecution:
    """Outcomes that are expressions of a run's columns.

    An expression is a column, or a function that is given ``ask`` and gets the
    run's columns from it by name. Functions alone let an edge's tests stay an
    array of its row.
    """

    output: Column | Callable[[Ask], Column]
    ok: Column | Callable[[Ask], Column] = lambda ask: F.lit(True)
    wall_ms: Column | Callable[[Ask], Column] = lambda ask: F.lit(0)
    keyed: bool = False

    @property
    def in_row(self) -> bool:
        return all(not isinstance(x, Column) for x in (self.output, self.ok, self.wall_ms))

    def outcome(self, ask: Ask) -> tuple[Column, Column, Column]:
        """(output, exit_ok, wall_ms) of a run."""
        output, ok, wall = (x if isinstance(x, Column) else x(ask) for x in (self.output, self.ok, self.wall_ms))
        return F.coalesce(output, F.lit("")), F.coalesce(ok, F.lit(False)), wall.cast("long")

    def execute(self, runs: DataFrame) -> DataFrame:
        return runs.withColumns(dict(zip(("output", "exit_ok", "wall_ms"), self.outcome(F.col), strict=True)))


class _Capped(threading.Thread):
    """Reads a stream to its end and keeps the first bytes; a longer stream ends the process at once."""

    def __init__(self, stream, end):
        super().__init__(daemon=True)
        self.stream, self.end, self.over = stream, end, False
        self.parts: list[bytes] = []
        self.start()

    def run(self) -> None:
        size = 0
        while block := self.stream.read1(65536):
            size += len(block)
            self.parts.append(block)
            if size > MOST_OUTPUT:
                self.over = True
                self.end()
                break

    @property
    def data(self) -> bytes:
        return b"".join(self.parts)[:MOST_OUTPUT]


@dataclass
class SubprocessExecution:
    """Runs programs by commands, by language: ``{file}`` stands for the program's file, ``{folder}`` and ``{name}`` for its parts.

    ``for_tests`` is what a command gets besides for a program of unit tests.
    Time, memory and output are bounded while the program runs; a process that
    goes over is killed with its children. Empty input means no input; with
    ``settle`` seconds the input waits and what was printed before it is
    dropped. At most ``workers`` programs run at a time.
    """

    commands: dict[str, list[str]] = field(default_factory=lambda: {"Python": [sys.executable, "{file}"]})
    extensions: dict[str, str] = field(default_factory=lambda: dict(EXTENSIONS))
    timeout: float = 90.0
    memory_mb: int = 4096
    settle: float = 0.0
    for_tests: tuple[str, ...] = ()
    workers: int = 4
    keyed: bool = True

    def execute(self, runs: DataFrame) -> DataFrame:
        run = self._run
        dealt, threads = spread(runs, self.workers)
        # A JavaScript program that imports is a module.
        dealt = dealt.withColumn("extension", F.coalesce(file_extension(F.col("language"), F.col("executed_code")), F.lit("")))

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = _side_by_side(run, zip(f["executed_code"], f["language"], f["stdin"], f["kind"], f["extension"], strict=True), threads)
                columns = {n: [g[k] for g in got] for k, n in enumerate(("stdout", "stderr", "exit_code", "timed_out", "wall_ms"))}
                yield f.assign(**columns)

        done = dealt.mapInPandas(work, f"{_schema(dealt)}, stdout binary, stderr binary, exit_code int, timed_out boolean, wall_ms long")
        ok = (F.col("exit_code") == 0) & ~F.col("timed_out") & F.is_valid_utf8(F.col("stdout").cast("string"))
        text = outcome_text(F.col("stdout").cast("string"), F.col("stderr").cast("string"), F.col("exit_code"), F.col("timed_out"))
        return done.withColumns({"output": text, "exit_ok": ok}).select(*runs.columns, "output", "exit_ok", "wall_ms")

    def _run(self, code: str, language: str, stdin: str, kind: str = RUN, extension: str | None = None) -> tuple[bytes, bytes, int, bool, int]:
        began = time.monotonic()
        if language not in self.commands:
            return b"", f"no runner for {language}".encode(), 127, False, 0
        with tempfile.TemporaryDirectory() as folder:
            name = "prog" + (self.extensions.get(language, "") if extension is None else extension)
            path = os.path.join(folder, name)
            with open(path, "w", encoding="utf-8") as f:
                f.write(code)
            parts = {"{file}": path, "{folder}": folder, "{name}": name}
            command = []
            for c in [*self.commands[language], *(self.for_tests if kind == TEST else ())]:
                for mark, value in parts.items():
                    c = c.replace(mark, value)
                command.append(c)
            limited = ["sh", "-c", f'ulimit -v {self.memory_mb * 1024}; exec "$@"', "sh", *command] if self.memory_mb else command
            process = subprocess.Popen(limited, stdin=subprocess.PIPE if stdin else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=folder, start_new_session=True)

            def end() -> None:
                with contextlib.suppress(ProcessLookupError):
                    os.killpg(process.pid, signal.SIGKILL)

            out, err = _Capped(process.stdout, end), _Capped(process.stderr, end)
            late = threading.Timer(self.timeout, end)
            late.start()
            try:
                if stdin:
                    if self.settle:
                        time.sleep(self.settle)
                        out.parts.clear()
                    with contextlib.suppress(BrokenPipeError):
                        process.stdin.write(stdin.encode())
                        process.stdin.close()
                process.wait()
                out.join(5)
                err.join(5)
            finally:
                in_time = late.is_alive()
                late.cancel()
                end()
        code_ = -1 if out.over or err.over else process.returncode
        return out.data, err.data, code_, not in_time, _ms(began)


#: What a container gets at most, and the script that its image runs programs with.
CONTAINER_MEMORY, CONTAINER_CPUS, CONTAINER_SCRIPT = "4G", "4", "/bin/script"
#: Seconds that a program in a container has to print its prompts before its input comes.
PROMPT_SECONDS = 3.0


def container_command(image: str) -> list[str]:
    """The command that runs a program's file in a container without network, home or privileges."""
    limits = ["--memory", CONTAINER_MEMORY, "--cpus", CONTAINER_CPUS, "--network", "none"]
    return ["singularity", "exec", *limits, "--writable-tmpfs", "--no-privs", "--no-home", "--containall", "--bind", "{folder}:/code:ro", image, CONTAINER_SCRIPT, "/code/{name}"]


def from_config(config: EngineConfig) -> tuple[HttpInference, SubprocessExecution]:
    """The providers that a configuration names: its endpoints and token, its container of each language, its numbers of workers."""
    if not config.endpoints:
        raise ConfigError("no inference endpoints")
    commands = {language: container_command(image) for language, image in config.containers.items()}
    # The container has limits of its own.
    run = SubprocessExecution(commands, memory_mb=0, settle=PROMPT_SECONDS, for_tests=("test",), workers=config.execution_workers)
    return HttpInference(tuple(config.endpoints), config.token, workers=config.inference_workers), run


def _ms(began: float) -> int:
    return int((time.monotonic() - began) * 1000)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
