"""Errors as records: each class names a row of the table of codes, and carries one frozen report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any, ClassVar

#: Error codes (fixed values).
CODES = (
    "INTERNAL_ERROR",
    "CONFIGURATION_ERROR",
    "VALIDATION_ERROR",
    "NOT_FOUND_ERROR",
    "PERMISSION_ERROR",
    "INDEXER_ERROR",
    "GRAPH_ERROR",
    "AGENT_ERROR",
    "API_ERROR",
    "EMBEDDING_ERROR",
    "MEMORY_ERROR",
    "EVENT_BUS_ERROR",
    "SYSTEM_STATE_ERROR",
    "PROJECT_ANALYSIS_ERROR",
    "QUERY_EXECUTION_ERROR",
    "LEARNING_ERROR",
)
#: Severities from least to most (fixed values); codes that aren't listed below are medium.
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_OF = {"CONFIGURATION_ERROR": "high"}


@dataclass(frozen=True)
class Report:
    """What is known of one error; text and record are views of it."""

    code: str
    severity: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    cause: tuple[str, str] | None = None
    timestamp: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def line(self) -> str:
        parts = [f"[{self.code}] {self.message}"]
        if self.cause:
            parts.append("Causa: {}: {}".format(*self.cause))
        return " | ".join(parts)

    def row(self) -> dict[str, Any]:
        known = {"error": self.code, **{k: getattr(self, k) for k in ("message", "severity", "timestamp", "details")}}
        return known | ({"cause": dict(zip(("type", "message"), self.cause))} if self.cause else {})


class EngineError(Exception):
    """The base; a subclass is declared with its code, and keyword arguments become details where they aren't empty."""

    code: ClassVar[str] = "INTERNAL_ERROR"

    def __init_subclass__(cls, code: str | None = None):
        if code is not None:
            if code not in CODES:
                raise ValueError(f"unknown error code: {code}")
            cls.code = code

    def __init__(self, message: str, cause: BaseException | None = None, code: str | None = None, severity: str | None = None, **details: Any):
        own = code or self.code
        if own not in CODES or severity not in (None, *SEVERITIES):
            raise ValueError(f"unknown error code or severity: {own}, {severity}")
        kept = {k: v for k, v in details.items() if v is not None and v != ""}
        self.report = Report(own, severity or SEVERITY_OF.get(own, "medium"), message, kept, (type(cause).__name__, str(cause)) if cause else None)
        super().__init__(self.report.line())
        self.__cause__ = cause

    @property
    def severity(self) -> str:
        return self.report.severity

    @property
    def details(self) -> dict[str, Any]:
        return self.report.details

    def to_dict(self) -> dict[str, Any]:
        return self.report.row()


class ConfigurationError(EngineError, code="CONFIGURATION_ERROR"):
    pass


class ValidationError(EngineError, code="VALIDATION_ERROR"):
    """Details: field, value, value_type, actual_length, suggestion."""


class IndexerError(EngineError, code="INDEXER_ERROR"):
    """Details: project_path, file_path."""


class GraphError(EngineError, code="GRAPH_ERROR"):
    """Details: query, node_id."""


class AgentError(EngineError, code="AGENT_ERROR"):
    """Details: agent_name, task_type."""


class APIError(EngineError, code="API_ERROR"):
    """Details: endpoint, status_code."""


class ProjectAnalysisError(EngineError, code="PROJECT_ANALYSIS_ERROR"):
    """Details: project_path, analysis_step."""


class EventBusError(EngineError, code="EVENT_BUS_ERROR"):
    pass


class StateError(EngineError, code="SYSTEM_STATE_ERROR"):
    pass


class WorkflowError(EngineError):
    """Details: workflow, step, id."""


class DependencyError(EngineError):
    pass
