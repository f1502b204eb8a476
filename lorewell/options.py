"""Settings of a corpus, their presets, and list-setting parsing."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Options:
    top_k: int = 12
    min_similarity: float = 0.2
    structure_influence: float = 0.15
    idea_influence: float = 0.3
    max_chunks: int = 48
    shortlist_size: int = 60
    new_note_min_similarity: float = 0.45
    title_weight: float = 2.0
    heading_context: bool = False
    show_summary: bool = False
    exclude_folders: tuple[str, ...] = ()
    isolated_areas: tuple[str, ...] = ()
    model_id: str = "hash-64"
    chunking: bool = True
    device: str = "auto"
    index_speed: str = "balanced"
    exclude_folders_links: tuple[str, ...] = ()

    @property
    def shortlist(self) -> int:
        return max(4 * self.top_k, self.shortlist_size)

    @property
    def link_excluded(self) -> tuple[str, ...]:
        """Folders whose notes are never linked: those outside the index, and those excluded from links alone."""
        return self.exclude_folders + self.exclude_folders_links

    def engine(self) -> tuple:
        """What needs another embedder when it changes."""
        return (self.model_id, self.device, self.index_speed)

    def shape(self) -> tuple:
        """What makes other chunks when it changes."""
        return (self.chunking, self.max_chunks, self.show_summary, self.heading_context)

    def rebuild(self, other: Options) -> str | None:
        """What a change to ``other`` asks for: ``engine`` (a new one, notes are reused by mtime), ``force`` (the same, all notes anew) or None."""
        return "engine" if self.engine() != other.engine() else "force" if self.shape() != other.shape() else None


#: Fixed values of the three presets.
PRESETS = {
    "default": Options(),
    "balanced": Options(top_k=8),
    "best": replace(Options(), top_k=20, structure_influence=0.2, idea_influence=0.35, max_chunks=64),
}


def parse_list(text: str) -> list[str]:
    """Entries between newlines or commas, without blanks around and slashes behind."""
    parts = (p.strip().rstrip("/") for p in re.split(r"[\n,]", text or ""))
    return [p for p in parts if p]


def parse_areas(text: str) -> list[str]:
    """The namespaces of the listed tags, each once."""
    return list(dict.fromkeys(p.lstrip("#").split("/")[0].lower() for p in parse_list(text) if p.lstrip("#")))
