"""Tables the operators start from: file listings, layout fixtures, sinks."""
