"""Processors by (provider, dataset, file): functions from the file's DataFrame to cleaned tables."""

from __future__ import annotations

from collections.abc import Callable

PROCESSORS: dict[tuple[str, str, str], Callable] = {}


def processor(provider: str, dataset: str, file: str) -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        key = (provider, dataset, file)
        if key in PROCESSORS:
            raise ValueError(f"there is a processor for {key}")
        PROCESSORS[key] = f
        return f

    return register


def processor_for(provider: str, dataset: str, file: str) -> Callable:
    """The file's own processor, else the data set's ('*')."""
    for key in ((provider, dataset, file), (provider, dataset, "*")):
        if key in PROCESSORS:
            return PROCESSORS[key]
    raise KeyError(f"no processor for {(provider, dataset, file)}")
