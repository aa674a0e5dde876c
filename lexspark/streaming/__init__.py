"""Landing newly fetched records as a stream."""
