"""The pattern language: tree, parser, validator."""

from .parser import SyntaxFault, parse
from .validate import ValidationFailed, Violation, validate

__all__ = ["SyntaxFault", "ValidationFailed", "Violation", "parse", "validate"]
