"""Runs one program on its cases and says how it did.

The grading process executes the text of this module, so it imports nothing
beyond Python's own library.  It reads {code, entry, cases, timeout} as JSON from
its input and writes {passed, code, message, n_run} to its output.
"""

import contextlib
import io
import json
import signal
import sys
from decimal import Decimal, InvalidOperation

# What went wrong, as graders of this kind report it.
WRONG, LATE, FAILED, HUNG = -2, -3, -4, -5

# Modules whose names programs may use without importing them, in this order, then modules by name.
OPEN_MODULES = "string re datetime collections heapq bisect copy math random statistics itertools functools operator io sys json builtins typing".split()
NAMED_MODULES = "string re datetime collections heapq bisect copy math random statistics itertools functools operator io sys json".split()


class TimeIsUp(BaseException):
    pass


def outputs_agree(actual: str, expected: str) -> bool:
    """Line by line, exactly or as decimal numbers word by word."""
    def numbers(line: str) -> list | None:
        try:
            return [Decimal(x) for x in line.split()]
        except InvalidOperation:
            return None

    a, b = ([x.strip() for x in text.strip().split("\n")] for text in (actual, expected))
    return len(a) == len(b) and all(x == y or (numbers(x) is not None and numbers(x) == numbers(y)) for x, y in zip(a, b))


def namespace(name: str) -> dict:
    space = {"__name__": name}
    exec("\n".join([f"from {m} import *" for m in OPEN_MODULES] + [f"import {m}" for m in NAMED_MODULES]), space)
    return space


def entry_of(code: str, entry: str):
    """The function of that name, or the method of a class named Solution."""
    space = namespace("program")
    exec(compile(code, "program", "exec"), space)
    return getattr(space["Solution"](), entry) if "Solution" in space else space[entry]


def called(function, case: dict) -> bool:
    """Arguments are JSON, one a line; a tuple counts as the list of its members."""
    got = function(*[json.loads(line) for line in case["input"].split("\n")])
    return (list(got) if isinstance(got, tuple) else got) == json.loads(case["output"])


def printed(code: str, case: dict) -> bool:
    """The whole program, from input to output; leaving early is no fault."""
    out, held = io.StringIO(), sys.stdin
    sys.stdin = io.TextIOWrapper(io.BytesIO((case["input"] or "").encode()))
    try:
        with contextlib.redirect_stdout(out), contextlib.suppress(SystemExit):
            exec(compile(code, "program", "exec"), namespace("__main__"))
    finally:
        sys.stdin = held
    return outputs_agree(out.getvalue(), case["output"] or "")


def verdict(job: dict) -> dict:
    def ring(*_):
        raise TimeIsUp

    signal.signal(signal.SIGALRM, ring)
    n = 0
    try:
        signal.setitimer(signal.ITIMER_REAL, job["timeout"])
        function = entry_of(job["code"], job["entry"]) if job["entry"] else None
        for n, case in enumerate(job["cases"], 1):
            signal.setitimer(signal.ITIMER_REAL, job["timeout"])
            if not (called(function, case) if function else printed(job["code"], case)):
                return {"passed": False, "code": WRONG, "message": "Wrong answer", "n_run": n}
    except TimeIsUp:
        return {"passed": False, "code": LATE, "message": "Time limit exceeded", "n_run": n}
    except BaseException as e:  # whatever the program raises, exits included, is its failure
        return {"passed": False, "code": FAILED, "message": f"{type(e).__name__}: {e}"[:500], "n_run": n}
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
    return {"passed": True, "code": None, "message": None, "n_run": n}


def main() -> None:
    job, out = json.loads(sys.stdin.read()), sys.stdout
    with contextlib.redirect_stdout(io.StringIO()):
        said = verdict(job)
    out.write("\n" + json.dumps(said))


if __name__ == "__main__":
    main()
