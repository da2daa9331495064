"""python -m tessera.tools.crash_commit TABLE after_fsync|after_rename|none [FILE...]: one commit, cut short if asked.

Exit 2: usage. 1: it failed or was cut short. 0: committed.
"""

from __future__ import annotations

import sys

from ..errors import LogError
from ..operators.transaction import CrashPoint, Transaction
from ..sources.storage import local_storage


def main(args: list[str]) -> int:
    points = {p.value: p for p in CrashPoint} | {"none": None}
    if len(args) < 2 or args[1] not in points:
        print(__doc__, file=sys.stderr)
        return 2
    try:
        txn = Transaction(local_storage(args[0]))
        for name in args[2:]:
            txn.add(name)
        print(txn.commit(points[args[1]]))
    except LogError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
