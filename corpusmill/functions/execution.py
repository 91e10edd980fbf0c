"""Running code of answers in a process of its own.  Off unless asked for: the code is not trusted."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType


def runs(code: str | None, timeout: float = 8.0, test: bool = False) -> bool:
    """Whether code ends without an error within the time: in a fresh folder, an isolated interpreter and a bare environment."""
    if not code:
        return False
    with tempfile.TemporaryDirectory() as d:
        name = os.path.join(d, "test_answer.py")
        with open(name, "w", encoding="utf-8", errors="surrogatepass") as f:
            f.write(code)
        command = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", name] if test else [sys.executable, "-I", name]
        try:
            return subprocess.run(command, cwd=d, env={"PATH": os.defpath}, stdin=subprocess.DEVNULL, capture_output=True, timeout=timeout).returncode == 0
        except (subprocess.TimeoutExpired, OSError):
            return False


def runs_ok(code: Column, allow: bool = False, timeout: float = 8.0, test: bool = False) -> Column:
    """A Column of verdicts; raises unless `allow` is given, as the workers then run what the texts say."""
    if not allow:
        raise PermissionError("running code of answers must be allowed explicitly")

    @pandas_udf(BooleanType())
    def verdict(c: pd.Series) -> pd.Series:
        return c.map(lambda x: runs(x, timeout, test)).astype(bool)

    return verdict(code)
