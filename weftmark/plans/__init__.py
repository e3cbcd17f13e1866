"""Plan-level helpers: session defaults, shared tables, distributed ranks."""
