"""Small helpers of the driver program."""

from __future__ import annotations

import inspect
import os

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def describe_error(error: BaseException) -> str:
    """Class and message."""
    return f"{type(error).__name__}: {error}"


def caller() -> str:
    """The calling function with its arguments, self and cls left out, as a call would be written."""
    frame = inspect.currentframe().f_back
    args, _, keywords, values = inspect.getargvalues(frame)
    shown = [repr(values[a]) for a in args if a not in ("self", "cls")] + [f"{k}={v!r}" for k, v in values.get(keywords or "", {}).items()]
    return f"{frame.f_code.co_name}({', '.join(shown)})"


def root_path(name: str | None = None, relative: bool = False, module: bool = False) -> str:
    """A path below the package's folder: absolute, relative to the working directory, or in dots as a module."""
    path = os.path.realpath(os.path.join(ROOT, name or ""))
    if module:
        return os.path.relpath(path, ROOT).removesuffix(".py").replace(os.sep, ".")
    return os.path.relpath(path) if relative else path


def percent(part: float | None, whole: float | None) -> float | None:
    """With one decimal; None where there is nothing to divide."""
    return None if part is None or not whole else round(100 * part / whole, 1)
