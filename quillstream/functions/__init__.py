"""The function library; importing it fills the registry."""

from . import aggregates, math, ml, network, paths, pii, sql_normalise, strings  # noqa: F401
from .core import REGISTRY, CompileError, Value, call, lift

__all__ = ["REGISTRY", "CompileError", "Value", "call", "lift"]
