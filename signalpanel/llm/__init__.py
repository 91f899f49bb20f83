"""Training-data pipeline operators (text, web pages, benchmarks).

Nothing else in the library imports this subpackage."""
