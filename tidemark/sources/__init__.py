"""Sources and sinks: source trees, run artefacts, ledgers, test results, reports."""
