"""Tables, snapshots, imports and exports."""
