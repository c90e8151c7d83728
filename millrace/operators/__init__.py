"""Table operators, each a ``DataFrame -> DataFrame`` function."""
