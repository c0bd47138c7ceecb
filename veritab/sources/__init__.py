"""Sources and sinks. Nothing here calls a network: what outside services said arrives as tables."""
