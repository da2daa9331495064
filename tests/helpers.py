import os

from tessera.operators.transaction import Transaction
from tessera.sources.log import write_log
from tessera.sources.storage import local_storage


def make_log(path, *entries):
    """A log of (adds, removes) by version; names are words."""
    storage = local_storage(path)
    for v, (adds, removes) in enumerate(entries):
        write_log(storage, v, adds.split(), removes.split())
    return storage


def commit(storage, adds="", removes="", reads=""):
    txn = Transaction(storage)
    for name in adds.split():
        txn.add(name)
    for name in removes.split():
        txn.remove(name)
    for name in reads.split():
        txn.track_read(name)
    return txn.commit()


def put(storage, key, text="x"):
    storage.write_all_text(key, text)


def data_files(storage):
    top = os.path.join(storage.root, "data")
    return sorted(n for n in os.listdir(top) if os.path.isfile(os.path.join(top, n)))
