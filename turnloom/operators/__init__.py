"""DataFrame to DataFrame operators over dialogue-act sequences."""
