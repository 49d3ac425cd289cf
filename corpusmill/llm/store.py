"""The shared-folder tables of the library, under this folder's name."""

from corpusmill.store import dropped, shared_folder, written

__all__ = ["dropped", "shared_folder", "written"]
