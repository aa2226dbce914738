"""Sources: policy files, and files of many kinds told apart by their first bytes."""
