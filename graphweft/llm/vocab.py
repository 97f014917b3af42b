"""Where vocabulary files lie. A bare name is looked up beside the installed tokenizer vocabularies."""

from __future__ import annotations

import os


def vocab_path(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class TwoGenerations:
    """A bounded cache: when the young generation is full it becomes the old one; hits move back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def fetch(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def resolve(self, keys: set, make) -> dict:
        """A table with the values of all keys; make(list of unknown keys) gives those that are not held."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        wanted = keys - young.keys()
        back = {k: old[k] for k in wanted & old.keys()} if old else {}
        new = list(wanted - back.keys())
        young.update(back)
        young.update(zip(new, make(new), strict=True))
        return young
