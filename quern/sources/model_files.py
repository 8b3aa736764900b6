"""The files of an embedding model beside each other in one folder: fetched if they are missing,
and fetched anew as a whole if they turn out to be broken."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from quern.streaming.refresh import Fetcher

V = TypeVar("V")
MODEL, VOCABULARY = "model.onnx", "tokenizer.json"


@dataclass
class ModelFiles:
    """fetch brings a file by its name. Offline nothing is fetched and nothing is deleted."""

    folder: str
    fetch: Fetcher
    names: tuple[str, ...] = (MODEL, VOCABULARY, "tokenizer_config.json")
    offline: bool = False

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def missing(self) -> list[str]:
        return [n for n in self.names if not os.path.exists(self.path(n))]

    def _bring(self, name: str) -> None:
        if self.offline:
            raise OSError(f"{name} is missing, and downloads are off")
        got = self.fetch(name, None)
        if not got.ok:
            raise OSError(f"{name}: status {got.status}")
        body = json.dumps(json.loads(got.body), indent=2, ensure_ascii=False).encode() if name.endswith(".json") else got.body
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.path(name)}.tmp", "wb") as f:
            f.write(body)
        os.replace(f"{self.path(name)}.tmp", self.path(name))

    def ensure(self) -> None:
        """Fetches the files that are missing, and no other."""
        for n in self.missing():
            self._bring(n)

    def renew(self) -> None:
        """Deletes all files and fetches them again."""
        if self.offline:
            raise OSError("downloads are off")
        for n in set(self.names) - set(self.missing()):
            os.remove(self.path(n))
        self.ensure()

    def load(self, read: Callable[[ModelFiles], V]) -> V:
        """read(self) with all files there; if it fails, once more with new ones, but not offline."""
        self.ensure()
        try:
            return read(self)
        except Exception:
            if self.offline:
                raise
            self.renew()
            return read(self)
