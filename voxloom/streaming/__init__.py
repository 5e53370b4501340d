"""Reports over folders that grow; an extension, for a run over all files does the same."""
