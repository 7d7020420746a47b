"""Sources and sinks: pins, the filing archive, the chunk store, results, labels and facts."""
