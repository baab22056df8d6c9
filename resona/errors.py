"""Typed errors: bad inputs, and failed execution."""

from __future__ import annotations


class DataContractError(ValueError):
    """A table or value breaks the contract of the operator it is given to."""


class ScoreTableError(DataContractError):
    """A score or label table cannot be evaluated."""


class MetricError(DataContractError):
    """A detection metric is undefined for its inputs."""


class FusionDataError(DataContractError):
    """Feature sources do not fit the manifest one to one."""


class FusionModelError(DataContractError):
    """A model is unknown or cannot be fitted as asked."""


class SpliceError(DataContractError):
    """A waveform cannot be searched for splices."""


class NoveltyError(DataContractError):
    """An embedding sequence cannot be searched for novelty."""


class AnalysisError(DataContractError):
    """Per-file features cannot be summarised."""


class ExecutionError(RuntimeError):
    """Work on well-formed inputs failed."""


class InferenceError(ExecutionError):
    """A window scorer failed or gave an impossible score."""


class RunnerError(ExecutionError):
    """A batch cannot be scored as a whole."""


class CepstralError(ExecutionError):
    """Cepstral peak prominence cannot be measured."""


class ServiceError(ExecutionError):
    """The explanation service failed."""


class ServiceNotConfigured(ServiceError):
    """The explanation service has no key."""


class AssetError(ExecutionError):
    """Model files are missing."""
