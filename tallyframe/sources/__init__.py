"""Sources and sinks: ledger files (CSV, workbooks) and report output."""
