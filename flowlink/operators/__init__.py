"""DataFrame operators: mapping, policy, linking, ledger, drift, audit and reports."""
