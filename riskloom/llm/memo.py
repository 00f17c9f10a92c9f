"""What a worker process remembers, in bounded memory."""

from __future__ import annotations

# What a dictionary entry takes besides the characters of its key and the bytes of its value.
_ENTRY = 190
# Places that tell which keys came once already, a byte each.
_SEEN = 1 << 20


class Memo:
    """Byte strings by text, in two generations of at most `most` bytes each.

    When the young generation is full it becomes the old one, whose keys are
    forgotten unless they are asked for again: frequent keys stay.
    """

    def __init__(self, most: int):
        self.most, self.size = most, 0
        self.seen: bytearray | None = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def find(self, keys: list[str]) -> tuple[list, list[int]]:
        """The values of the keys, None where unknown, and the places of those."""
        found = list(map(self.young.get, keys))
        unknown = []
        if None in found:
            for i in [i for i, value in enumerate(found) if value is None]:
                value = found[i] = self.old.get(keys[i])
                if value is None:
                    unknown.append(i)
                else:
                    self.put(keys[i], value)
        return found, unknown

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if self.size >= self.most:
            self.old, self.young, self.size, self.seen = self.young, {}, 0, None
        self.young[key] = value
        self.size += _ENTRY + 2 * len(key) + len(value)

    def put_again(self, key: str, value: bytes) -> None:
        """`put` from the second time on that a key comes in a generation: keys that come only once take no room.

        Another key may have the same place and let one in early; what is found stays the same.
        """
        if self.seen is None:
            self.seen = bytearray(_SEEN)
        place = hash(key) % _SEEN
        if self.seen[place]:
            self.put(key, value)
        else:
            self.seen[place] = 1
