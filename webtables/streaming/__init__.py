"""The shuffle-free operators run over a stream of captures."""
