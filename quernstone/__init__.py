"""Analytics over an assistant's memories, logs, component registries and dependency graphs, as Spark DataFrame operators."""
