"""The shared strings of one workbook, by index."""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections import OrderedDict
from collections.abc import Iterator

from parchmill.formats.storage import resolve

IN_MEMORY = 4_000_000  # characters; strings beyond are in a file of the shared folder
BLOCK = 64  # strings that are read together
CACHED = 256  # blocks of the file in memory


class SharedStrings:
    """Strings are looked up while the rows of their workbook stream by.

    The first IN_MEMORY characters are kept. The rest goes to a file in `folder`, in order
    and in blocks; the index has one offset a block, so a look-up reads one block. Rows
    name strings about in the order of their first use, so most blocks are read once.
    Without a folder all are kept.
    """

    def __init__(self, strings: Iterator[str], folder: str | None = None):
        self.kept: list[str] = []
        size = 0
        for s in strings:
            self.kept.append(s)
            size += len(s)
            if size > IN_MEMORY and folder is not None:
                break
        self.offsets, self.count, self.blocks = array("Q", [0]), len(self.kept), OrderedDict()
        self.file = None
        rest = self._blocks(strings)
        first = next(rest, None)
        if first is None:
            return
        fs, root = resolve(folder)
        fs.create_dir(root, recursive=True)
        self.fs, self.path = fs, f"{root}/{uuid.uuid4().hex}"
        with fs.open_output_stream(self.path) as out:
            for block in itertools.chain([first], rest):
                raw = [s.encode() for s in block]
                data = array("I", map(len, raw)).tobytes() + b"".join(raw)
                out.write(data)
                self.offsets.append(self.offsets[-1] + len(data))
                self.count += len(block)
        self.file = fs.open_input_file(self.path)

    @staticmethod
    def _blocks(strings: Iterator[str]) -> Iterator[list[str]]:
        while block := list(itertools.islice(strings, BLOCK)):
            yield block

    def get(self, index: int) -> str | None:
        """The string; None if there is none of that index."""
        if 0 <= index < len(self.kept):
            return self.kept[index]
        if not len(self.kept) <= index < self.count:
            return None
        number, place = divmod(index - len(self.kept), BLOCK)
        block = self.blocks.get(number)
        if block is None:
            block = self.blocks[number] = self._read(number)
            if len(self.blocks) > CACHED:
                self.blocks.popitem(last=False)
        else:
            self.blocks.move_to_end(number)
        return block[place]

    def _read(self, number: int) -> list[str]:
        n = min(BLOCK, self.count - len(self.kept) - number * BLOCK)
        begin, end = self.offsets[number], self.offsets[number + 1]
        data = self.file.read_at(end - begin, begin)
        ends = list(itertools.accumulate(memoryview(data)[: 4 * n].cast("I"), initial=4 * n))
        return [data[a:b].decode() for a, b in itertools.pairwise(ends)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.fs.delete_file(self.path)
            self.file = None
