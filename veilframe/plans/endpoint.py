"""A model behind an HTTP endpoint as the last layer of the classification funnel.

``HttpModel`` is a callable for ``Classifier.classify_fields(llm=...)``. Executors ask the endpoint about what the earlier
layers leave open, each different (field, value) once however many rows share it. A task has ``workers`` requests on
their way at a time; ones that meet a failure that may pass (no connection, status 429 or 5xx) are repeated after a
growing pause, as long as the server asks for if it says so.

Answers are kept: a task writes them to the folder ``answers`` as they come, and a task that is run again reads
first what its questions have got there. With a folder of one's own they last from run to run. A refusal or an answer that
names no level of the taxonomy is an answer; a failure is none, leaves its rows as they were and is asked again next time.

The endpoint must be http or https and no link-local address. Its name is looked up once a task, and requests go to the
address that was checked; redirects are not followed. Of a value the first ``SHOWN`` characters are sent, and values
that agree in these are one question.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import ssl
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.plans.model import Taxonomy
from veilframe.plans.storage import persisted, shared_dir
from veilframe.sources.arrow import located

SHOWN, CONNECT, PAUSE, BUNDLE = 100, 5.0, 0.5, 64
PROMPT = "How sensitive is one field of a data set? Choose from the levels below, the least sensitive first."


def address_of(endpoint: str | None) -> tuple[str, str, int, str, str] | None:
    """(scheme, host, port, path, address) of an endpoint that may be asked; None if it may not."""
    parts = urllib.parse.urlsplit(endpoint or "")
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    try:
        port = parts.port or (443 if parts.scheme == "https" else 80)
        found = [info[4][0] for info in socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)]
    except (OSError, ValueError):
        return None
    if not found or any(ipaddress.ip_address(a.partition("%")[0]).is_link_local for a in found):
        return None
    return parts.scheme, parts.hostname, port, urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), found[0]


def allowed(endpoint: str | None) -> bool:
    """Whether an endpoint may be asked: http or https, and not at a link-local address."""
    return address_of(endpoint) is not None


class _Connection(http.client.HTTPConnection):
    """To an address that is known, whatever its name may lead to by now."""

    def __init__(self, scheme: str, host: str, port: int, address: str, timeout: float):
        super().__init__(host, port, timeout=timeout)
        self.scheme, self.address = scheme, address

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), CONNECT)
        self.sock.settimeout(self.timeout)
        if self.scheme == "https":
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)


class _Failed(Exception):
    """No answer: ``pause`` seconds until another try, None if that is no use."""

    def __init__(self, pause: float | None):
        self.pause = pause


def shown(value: str | None) -> str:
    value = value or ""
    return value[:SHOWN] + "..." if len(value) > SHOWN else value


@dataclass(frozen=True)
class HttpModel:
    endpoint: str
    taxonomy: Taxonomy
    model: str = "default"
    prompt: str = PROMPT
    timeout: float = 30.0
    workers: int = 8
    attempts: int = 4
    tasks: int = 32
    answers: str | None = None

    def body(self, field: str, value: str) -> bytes:
        levels = "".join(f"\n- {level}" + (f" ({self.taxonomy.names[level]})" if level in self.taxonomy.names else "") for level, _ in sorted(self.taxonomy.levels.items(), key=lambda x: x[1]))
        example = next(iter(self.taxonomy.levels), "")
        text = f"{self.prompt}{levels}\nThe field is called {json.dumps(field, ensure_ascii=False)} and holds {json.dumps(value, ensure_ascii=False)}.\nAnswer with one JSON object that names the level, like {json.dumps({'level': example})}, and nothing else."
        return json.dumps({"model": self.model, "messages": [{"role": "user", "content": text}], "temperature": 0.1, "max_tokens": 50}).encode()

    def level_of(self, answer: str) -> str | None:
        """The level that an answer names, in the taxonomy's writing; None if there is none."""
        known = {level.casefold(): level for level in self.taxonomy.levels}
        try:
            found = json.loads(answer)
            if isinstance(found, dict) and "level" not in found:
                content = found["choices"][0]["message"]["content"]
                found = json.JSONDecoder().raw_decode(content, content.index("{"))[0]
            return known.get(str(found["level"]).strip().casefold())
        except (ValueError, LookupError, TypeError, AttributeError):
            return None

    def _once(self, at: tuple[str, str, int, str, str], field: str, value: str) -> str | None:
        scheme, host, port, path, address = at
        connection = _Connection(scheme, host, port, address, self.timeout)
        try:
            connection.request("POST", path, self.body(field, value), {"Content-Type": "application/json"})
            got = connection.getresponse()
            text = got.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            raise _Failed(0.0) from e
        finally:
            connection.close()
        if got.status == 429 or got.status >= 500:
            wait = got.getheader("Retry-After", "")
            raise _Failed(min(float(wait), self.timeout) if wait.isdecimal() else 0.0)
        return self.level_of(text) if got.status == 200 else None

    def answer(self, at: tuple[str, str, int, str, str], field: str, value: str) -> tuple[bool, str | None]:
        """(whether there was an answer, its level)."""
        for i in range(self.attempts):
            try:
                return True, self._once(at, field, value)
            except _Failed as e:
                if i + 1 < self.attempts:
                    time.sleep(max(e.pause or 0.0, PAUSE * 2**i))
        return False, None

    def ask(self, field: str, value: str | None) -> str | None:
        at = address_of(self.endpoint)
        return self.answer(at, field, shown(value))[1] if at else None

    def _asked(self, folder: str):
        """For a task's questions (key, field, value): the answers (key, level), kept as they come."""

        def run(batches) -> Iterator[pa.RecordBatch]:
            part = f"part-{TaskContext.get().partitionId():05d}-"
            store, root = located(folder)
            known: dict[str, str | None] = {}
            store.create_dir(root, recursive=True)
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith(part):
                    with store.open_input_stream(f.path) as lines:
                        known |= {x["key"]: x.get("level") for x in map(json.loads, lines.read().decode().splitlines())}
            at = address_of(self.endpoint)

            def keep(found: dict[str, str | None]) -> None:
                scratch = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(scratch, compression=None) as out:
                    out.write("".join(json.dumps({"key": k, "level": v}) + "\n" for k, v in found.items()).encode())
                store.move(scratch, f"{root}/{part}{uuid.uuid4().hex}.json")

            with ThreadPoolExecutor(self.workers) as pool:
                for b in batches:
                    rows = list(zip(*(b.column(c).to_pylist() for c in ("key", "field", "value")), strict=True))
                    for lo in range(0, len(rows), BUNDLE):
                        own = rows[lo : lo + BUNDLE]
                        fresh = [r for r in own if r[0] not in known] if at else []
                        told = dict(zip((r[0] for r in fresh), pool.map(lambda r: self.answer(at, r[1], r[2]), fresh), strict=True))
                        if found := {k: level for k, (there, level) in told.items() if there}:
                            keep(found)
                            known |= found
                        out = [(k, known[k]) for k, _, _ in own if k in known]
                        if out:
                            yield pa.record_batch([pa.array([k for k, _ in out]), pa.array([v for _, v in out], pa.string())], ["key", "level"])

        return run

    def __call__(self, rows: DataFrame) -> DataFrame:
        """(record_id, field, value) -> (record_id, field, level)."""
        spark = rows.sparkSession
        folder = self.answers or f"{shared_dir(spark)}/veilframe/answers-{uuid.uuid4().hex}"
        value = F.coalesce("value", F.lit(""))
        seen = F.when(F.length(value) > SHOWN, F.concat(F.substring(value, 1, SHOWN), F.lit("..."))).otherwise(value)
        # Levels and model are part of the question: a kept answer is to what was asked.
        frame = json.dumps([self.model, self.prompt, self.taxonomy.levels, self.taxonomy.names], sort_keys=True, ensure_ascii=False)
        asked = rows.select("record_id", "field", F.sha2(F.to_json(F.array(F.lit(frame), F.col("field"), seen)), 256).alias("key"), seen.alias("value"))
        questions = asked.groupBy("key").agg(F.first("field").alias("field"), F.first("value").alias("value"))
        # A question keeps its task, and so finds its answers, whenever it is asked.
        dealt = questions.repartition(self.tasks, "key")
        answers = persisted(dealt.mapInArrow(self._asked(folder), "key string, level string"), "answers")
        return asked.join(answers, "key").select("record_id", "field", "level")
