from millrace.plans.datasets import DATASETS, IDENTITY, Dataset, route_files
from millrace.plans.ingest import LoadError, load_file, load_files, load_release, object_paths
from millrace.plans.ledger import load_folder, pending, read_ledger

__all__ = [
    "DATASETS",
    "IDENTITY",
    "Dataset",
    "LoadError",
    "load_file",
    "load_files",
    "load_folder",
    "load_release",
    "object_paths",
    "pending",
    "read_ledger",
    "route_files",
]
