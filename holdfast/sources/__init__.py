from holdfast.sources import containers, layouts  # noqa: F401  the layouts register themselves
