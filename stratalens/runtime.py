"""Call controls shared by all analyses: progress, cancellation, timeouts, and errors without cell values.

A watcher thread cancels the call's Spark jobs by their job tag, so a cancelled or late call stops at once and not at
the next step of the driver.
"""

from __future__ import annotations

import functools
import inspect
import sys
import threading
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

CONTROLS = ("progress", "cancel", "timeout", "safe_errors", "position", "identify")
EVERY = 0.2


class AnalysisCancelled(RuntimeError):
    """The call was cancelled or ran out of time."""


class AnalysisError(RuntimeError):
    """A failure reported without source values; `kind` names the original exception's class."""

    def __init__(self, operation: str, kind: str, condition: str | None = None):
        self.operation, self.kind, self.condition = operation, kind, condition
        super().__init__(f"{operation} failed: {kind}" + (f" [{condition}]" if condition else ""))


class CancellationToken:
    """Set from any thread to stop the calls that hold it."""

    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


@dataclass(frozen=True)
class ProgressEvent:
    """One step of a running call."""

    operation: str
    phase: str
    completed: int
    total: int | None
    elapsed: float
    status: str = "running"


class ProgressDisplay:
    """Writes one line per phase to a stream."""

    def __init__(self, stream=None):
        self.stream = stream or sys.stderr

    def __call__(self, event: ProgressEvent) -> None:
        of = f"/{event.total}" if event.total else ""
        self.stream.write(f"{event.operation}: {event.phase} {event.completed}{of} ({event.elapsed:.1f}s) {event.status}\n")


class Session:
    """What one outermost call owns: its controls, its cached frames and identities."""

    def __init__(self, operation: str, progress=None, cancel=None, timeout=None, safe_errors=False, position=None, identify=True):
        if progress is True:
            progress = ProgressDisplay()
        if progress not in (None, False) and not callable(progress):
            raise TypeError("progress must be True, False, None or a callable")
        if timeout is not None and not timeout > 0:
            raise ValueError("timeout must be positive")
        self.operation, self.progress, self.token, self.safe, self.position, self.identify = operation, progress or None, cancel, safe_errors, position, identify
        self.began, self.deadline = time.monotonic(), timeout and time.monotonic() + timeout
        self.tag, self.stopped, self.last = f"stratalens-{uuid.uuid4().hex}", None, 0.0
        self.frames: dict = {}
        self.identities: dict = {}

    def check(self) -> None:
        if self.stopped or (self.token and self.token.cancelled) or (self.deadline and time.monotonic() > self.deadline):
            raise AnalysisCancelled(self.stopped or ("cancelled" if self.token and self.token.cancelled else "timeout"))

    def report(self, phase: str, completed: int, total: int | None, status: str = "running", force: bool = False) -> None:
        now = time.monotonic()
        if self.progress and (force or now - self.last >= EVERY):
            self.last = now
            self.progress(ProgressEvent(self.operation, phase, completed, total, now - self.began, status))

    def keep(self, frame: DataFrame) -> DataFrame:
        self.frames[id(frame)] = frame.persist()
        return frame

    def close(self) -> None:
        for frame in self.frames.values():
            frame.unpersist()
        self.frames.clear()


CURRENT: ContextVar[Session | None] = ContextVar("stratalens_session", default=None)


def session() -> Session:
    return CURRENT.get() or Session("call")


@contextmanager
def phase(name: str, total: int | None = None):
    """Report a phase; the value is called once per finished step."""
    own, done = session(), 0
    own.check()
    own.report(name, 0, total, force=True)

    def step(n: int = 1):
        nonlocal done
        done += n
        own.check()
        own.report(name, done, total)

    yield step
    own.report(name, done, total, "done", force=True)


def _watch(own: Session, spark: SparkSession, over: threading.Event) -> None:
    while not over.wait(0.1):
        late = own.deadline and time.monotonic() > own.deadline
        if late or (own.token and own.token.cancelled):
            own.stopped = "timeout" if late else "cancelled"
            spark.sparkContext.cancelJobsWithTag(own.tag)
            return


def operation(name: str):
    """Give a function the runtime controls; nested calls share the outermost one's."""

    def wrap(function):
        names = set(inspect.signature(function).parameters)
        open_ = any(x.kind is inspect.Parameter.VAR_KEYWORD for x in inspect.signature(function).parameters.values())

        @functools.wraps(function)
        def run(*args, **kwargs):
            unknown = sorted(set(kwargs) - names - set(CONTROLS))
            if unknown and not open_:
                raise TypeError(f"{name}() got an unexpected option {unknown[0]!r}")
            controls = {k: kwargs.pop(k) for k in CONTROLS if k in kwargs and k not in names}
            if CURRENT.get() is not None:
                return function(*args, **kwargs)
            own = Session(name, **controls)
            mark, over, spark = CURRENT.set(own), threading.Event(), SparkSession.getActiveSession()
            watched = spark is not None and (own.deadline or own.token)
            if watched:
                spark.sparkContext.addJobTag(own.tag)
                threading.Thread(target=_watch, args=(own, spark, over), daemon=True).start()
            try:
                own.check()
                out = function(*args, **kwargs)
                own.report(name, 1, 1, "finished", force=True)
                return out
            except (AnalysisCancelled, AnalysisError):
                raise
            except Exception as error:
                if own.stopped:
                    raise AnalysisCancelled(own.stopped) from None
                if own.safe:
                    condition = error.getCondition() if isinstance(error, PySparkException) else None
                    raise AnalysisError(name, type(error).__name__, condition) from None
                raise
            finally:
                over.set()
                if watched:
                    spark.sparkContext.removeJobTag(own.tag)
                own.close()
                CURRENT.reset(mark)

        return run

    return wrap
